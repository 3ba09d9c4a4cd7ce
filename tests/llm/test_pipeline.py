"""Every stage of the pipeline against brute force over its own input, or against SQL where SQL can express it."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from test_operators import ODD, SF, brute_features, brute_links, frame, whole_encoder

from tessera.llm import queries as Q
from tessera.llm.common import clear_intermediates, materialise

SPACE = " \t\n\x0b\x0c\r"
PROSE = " ".join(f"prose{i * i % 89}x{i}" for i in range(60))
ITEM = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' ORDER BY length(text) DESC LIMIT 1").fetchall()[0][0]
#: Rows that survive the rules, among them two texts under one id, near copies, repeated rows, null ids and passages of an item.
MORE = [
    (21, PROSE, "en", "a", 1),
    (22, PROSE.replace("x30", "changed"), None, None, None),
    (23, " ".join(f"other{i * i % 97}y{i}" for i in range(60)), "en", "a", 1),
    (23, " ".join(f"third{i * i % 83}z{i}" for i in range(60)), "en", "a", 1),
    (24, " ".join(f"third{i * i % 83}z{i}" for i in range(60)).upper(), "en", "a", 1),
    (25, PROSE + " own " + PROSE[::-1], "fr", "a", 1),
    (25, PROSE + " own " + PROSE[::-1], "fr", "a", 1),
    (26, f"{PROSE[:200]} {ITEM} {PROSE[200:]}", "en", "a", 1),
    (27, " ".join(w for i, w in enumerate(ITEM.split()) if i != 9) + " and then some more words", "en", "a", 1),
    (None, PROSE, "en", "a", 1),
    (None, PROSE, "en", "a", 1),
    (None, PROSE.replace("x30", "changed"), "en", "a", 1),
    (28, "\n".join(f"A line that three documents share {k}" for k in range(8)) + "\n" + PROSE[50:], "en", "a", 1),
    (29, "\n".join(f"a LINE that three documents share {k} " for k in range(8)) + "\nown", "en", "a", 1),
    (None, "\n".join(f"\tA line that three documents share {k}" for k in range(8)) + "\nown", "en", "a", 1),
]


def keyed(rows):
    """Rows as a multiset: id, text and source."""
    return Counter((r.doc_id, r.text, r.source) for r in rows)


def lines(rows):
    """What line dedup leaves of (id, text) rows, in their order."""
    split = [[(line, line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})) for line in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for (d, _), own in zip(rows, split):
        for _, key in own:
            if len(key) >= 20:
                holders[key].add(d)
    keeper = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    return ["\n".join(line for line, key in own if key not in keeper or keeper[key] == d) for (d, _), own in zip(rows, split)]


def nearest(item, text):
    """The least word edit distance of an item to any passage of a text, row by row over the item's words."""
    if not text.size:
        return len(item)
    row = np.zeros(len(text) + 1, np.int64)
    at = np.arange(len(text) + 1)
    for i, w in enumerate(item):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (text != w), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def holds_item(rows, items):
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in (t or "").encode().lower().split()], np.int64)
    coded = [code(t) for t in items]
    return [any(len(i) and nearest(i, own) <= int(0.15 * len(i)) for i in coded) for own in (code(t) for _, t in rows)]


def check_stage(name, before, after):
    """One stage's rows, given those before it."""
    pairs = [(r.doc_id, r.text) for r in before]
    if name == "line dedup":
        assert keyed(after) == Counter((r.doc_id, t, r.source) for r, t in zip(before, lines(pairs)))
        assert all(r.n_chars == len(r.text) for r in after)
    elif name == "n-gram Jaccard join":
        different = sorted({p for p in pairs if p[0] is not None}, key=lambda p: (p[0], p[1] or ""))
        groups = defaultdict(list)
        classes = {(d, digest): c for d, c, _, digest in brute_links(different)}
        # Classes by their least id; texts under one id may be several classes.
        for r in after:
            if r.doc_id is not None:
                groups[r.doc_id].append(r.text)
        assert Counter(t for d, t in pairs if d is None) == Counter(r.text for r in after if r.doc_id is None)
        assert len({(r.doc_id, r.text) for r in after if r.doc_id is not None}) == sum(r.doc_id is not None for r in after)
        kept = {(r.doc_id, r.text) for r in after if r.doc_id is not None}
        assert kept <= set(different)
        md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
        assert {classes[d, md5(t)] for d, t in kept} == set(classes.values()) and all(classes[d, md5(t)] == d for d, t in kept)
        left = brute_links(sorted(kept, key=lambda p: (p[0], p[1] or "")))
        assert not any(links for *_, links, _ in left)
    elif name == "benchmark decontamination":
        items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
        assert keyed(after) == keyed(r for r, bad in zip(before, holds_item(pairs, items)) if not bad)


def check_packing(before, got):
    library = whole_encoder("word_bpe_49k.json")
    want = Counter()
    for r in before:
        ids = np.append(library(r.text), np.uint32(1))
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[r.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].astype("<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)])]
        assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 4096 + 1


def run_stages(spark, docs, first):
    rows = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = materialise(stage(spark, docs, SF), "test-stage")
        got = after.collect()
        if k == 0:
            first(rows, got)
        elif k < 4:
            check_stage(name, rows, got)
        else:
            check_packing(rows, got)
        if k < 4:
            assert after.columns == docs.columns, name
        docs, rows = after, got
    clear_intermediates(spark)


def test_stages(spark):
    def by_sql(before, after):
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        kept = {d for d, k in con.sql(f"SELECT doc_id, kept FROM ({Q.OP2_SQL})").fetchall() if k}
        assert 0 < len(kept) < len(before) and keyed(after) == keyed(r for r in before if r.doc_id in kept)

    run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), by_sql)


def test_odd_rows(spark):
    def by_rule(before, after):
        # So few rows certify no cutoff: only the base rule rejects.
        features = [brute_features(r.text) for r in before]
        assert keyed(after) == keyed(r for r, f in zip(before, features) if f[0] >= 20 and 100 * f[4] <= 30 * f[0])

    run_stages(spark, frame(spark, ODD + MORE), by_rule)


def test_unrelated_texts_under_one_id_stay(spark):
    rows = [(5, PROSE, "en", "a", 1), (5, re.sub("prose", "verse", PROSE), "en", "a", 1)]
    got = corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), SF).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t, *_ in rows)


@pytest.mark.parametrize("rows", [[]])
def test_empty(spark, rows):
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0
