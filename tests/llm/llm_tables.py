"""Small tables and plain versions for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate double, _text string, `class` string, label string, _row string"


def documents(spark, texts, langs=("en",), sources=("a",), ids=None):
    """Documents with extra columns whose names operators might use."""
    rows = []
    for i, text in enumerate(texts):
        number = i if ids is None else ids[i]
        rows.append((number, text, langs[i % len(langs)], sources[i % len(sources)], None if text is None else len(text), 1.0, "x", "y", "z", "w"))
    return spark.createDataFrame(rows, SCHEMA)


def some_words(seed, count, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(count)]


def plain_shingles(text, width):
    words = tuple((text or "").encode().lower().split())
    if not words:
        return frozenset()
    return frozenset(words[i : i + width] for i in range(max(1, len(words) - width + 1)))


def plain_components(rows, width, percent):
    """For each row the smallest id reachable by links, comparing all pairs."""
    sets = [plain_shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[find(i)] = find(j)
    least = {}
    for i, (number, _) in enumerate(rows):
        if number is not None:
            root = find(i)
            least[root] = min(least.get(root, number), number)
    return [(number, len(sets[i]), least.get(find(i))) for i, (number, _) in enumerate(rows)]


def near_copies(seed=5):
    """Groups of copies and near copies, a passage many share, short, empty and null texts."""
    r = random.Random(seed)
    passage = some_words(99, 30)
    texts = []
    for group in range(12):
        base = some_words(group, r.randrange(20, 90))
        for _ in range(r.randrange(1, 9)):
            words = list(base)
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(words))
        texts.append(" ".join(base + passage))
        texts.append(" ".join(passage + some_words(group + 500, 8)))
    return [*texts, texts[0], texts[0].upper(), "", None, " \t\n", "one two", "One  two", "one", "a b c d", "é É"]


def plain_secrets(text):
    text = text or ""
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def oracle_rows(sql, **tables):
    """Rows of DuckDB SQL over Spark tables, with sorted columns."""
    import duckdb

    connection = duckdb.connect()
    for name, table in tables.items():
        connection.register(f"{name}_in", table.toArrow())
        connection.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_in")
    return sorted_rows(connection.execute(sql).to_arrow_table())


def sorted_rows(table):
    """Rows of a Spark or Arrow table as sorted texts."""
    table = table.toArrow() if hasattr(table, "toArrow") else table
    return sorted(repr([row[c] for c in sorted(row)]) for row in table.to_pylist())


def plain_repeats(text):
    """Words of 8-word windows that occur twice or more."""
    words = (text or "").encode().split()
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + j for v in places.values() if len(v) > 1 for i in v for j in range(8)})
