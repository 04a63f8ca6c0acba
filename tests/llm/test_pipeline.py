"""Stages of the pipeline against plain versions."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_llm import brute_components, frame, text


def documents(rng):
    rows = []
    for i in range(90):
        w = rng.choice(rows)[1].split("\n")[0].split() if rows and rng.random() < 0.4 else text(rng, rng.randint(1, 60)).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 999)}"
        rows.append((i, " ".join(w) + rng.choice(["", "\nmenu", "\nmenu\nhome", "\n \nhome"]), "en", rng.choice(["a", "b", None]), 0))
    return rows


def test_line_deduplication_and_near_duplicates(spark, tmp_path):
    rows = documents(random.Random(3))
    docs = frame(spark, rows)
    pages, lines = Counter(r[3] for r in rows), defaultdict(set)
    for i, t, _, host, _ in rows:
        for line in t.split("\n"):
            if line.strip():
                lines[host, line].add(i)
    bad = {k for k, v in lines.items() if len(v) >= 5 and len(v) > 0.1 * pages[k[0]]}
    want = {i: "\n".join(x for x in t.split("\n") if (host, x) not in bad) for i, t, _, host, _ in rows}
    clashing = docs.withColumns({"n_lines": F.lit("mine"), "n_dropped": F.lit("mine too")})
    out = corpus_pipeline.line_deduplication(spark, clashing, str(tmp_path))
    got = out.collect()
    assert out.columns == clashing.columns and {r.doc_id: r.text for r in got} == want and bad
    assert all(r.n_lines == "mine" and r.n_dropped == "mine too" and r.n_chars == len(r.text) for r in got)
    found = brute_components([(i, t) for i, t in want.items()], 5, 80)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, out, str(tmp_path)).collect()}
    assert kept == {i for i, (_, c) in found.items() if i == c} and len(kept) < len(rows)


def test_packed_sequences(spark, tmp_path):
    rows = documents(random.Random(4))
    pieces = corpus_pipeline.packed_sequences(spark, frame(spark, rows), str(tmp_path)).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    assert {p.doc_id for p in pieces} == {r[0] for r in rows}
    for places in by.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0 and sum(n for _, n in places) <= 4096
    assert len(by) == -(-sum(p.length for p in pieces) // 4096)
