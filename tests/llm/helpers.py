"""Small documents with every awkward case, and plain versions of the contracts."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, block int, row long, label string"


def rows(texts, start=1):
    """(columns of COLUMNS) with names that clash with the operators' own."""
    return [(i, t, None if i % 3 else "en", None if i % 5 == 0 else f"src{i % 3}", None, "x", 7, 3, 1, None) for i, t in enumerate(texts, start)]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def sentence(seed, n):
    """n invented words, repeatable."""
    out, x = [], seed * 2654435761 % 2**32 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("w" + format(x % 5000, "x") + "é" * (x % 7 == 0))
    return " ".join(out)


def awkward():
    long = sentence(3, 4000)
    return [None, "", " \t\n", "one", sentence(1, 60), sentence(1, 60), sentence(1, 60) + " end", long, long, sentence(2, 19), "\n\n" + sentence(1, 40), "a " * 300, "    x" * 30, sentence(5, 30) + "\n" + sentence(1, 45)]


def plain_links(texts, size=5, least=0.8):
    sets = {}
    for i, t in enumerate(texts, 1):
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set()
    links = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])} for i in sets}
    classes = {}
    for i in links:
        if i not in classes:
            stack = [i]
            while stack:
                at = stack.pop()
                if at not in classes:
                    classes[at] = i
                    stack += links[at]
    return {i: (classes[i], len(links[i])) for i in sets}
