from __future__ import annotations

import corpus_pipeline as pipeline
from pagefold.llm import near, pieces, substrings

from .cases import empty, frame, prose, rows, seen


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before, docs = docs.persist(), stage(spark, docs, small).persist()
        assert docs.count() <= before.count()
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == names, name
        if name == "near_dedup":
            left = {r.doc_id for r in docs.select("doc_id").collect()}
            assert left == {r.doc_id for r in near.near_duplicates(before, percent=near.STAGE_PERCENT).collect() if r.kept}
        if name == "substring_dedup":
            assert docs.count() == before.count() and docs.filter("n_chars <> length(text)").count() == 0
            assert docs.exceptAll(before).count() == substrings.removal_digest(before).filter("n_removed > 0").count()
        if name == "sentencepiece":
            assert docs.columns == ["doc_id", "n_tokens", "ids"]
            back = {r.doc_id: r.text for r in pieces.decode(docs, pieces.load(spark, pieces.MODEL)).collect()}
            assert back == {r.doc_id: r.text for r in before.collect()}


def test_middle_stages_against_brute_force(spark, small):
    """Near-dedup, substring dedup and decontamination of the awkward cases, from plain sets and lists of words."""
    import re

    spaces, plain = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").select("text").collect()]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    own = [(d, t) for d, t, *_ in rows()] + [(2000, bench[0]), (2001, bench[1] + " some words of its own"), (2002, prose(61, 300) + " " + bench[2])]
    df = spark.createDataFrame([(d, t, "en", "s", None) for d, t in own], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)

    def sets(t):
        w = spaces.findall((t or "").translate(low))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    shingled = [sets(t) for _, t in own]
    group = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if own[i][0] is not None and own[j][0] is not None and shingled[i] and 100 * len(shingled[i] & shingled[j]) >= 80 * len(shingled[i] | shingled[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(own[k][0] for k in range(len(own)) if group[k] == g) for g in set(group) if own[group.index(g)][0] is not None}
    left = [x for k, x in enumerate(own) if x[0] is None or not shingled[k] or least[group[k]] == x[0]]
    got = stages["near_dedup"](spark, df, small)
    assert got.columns == names and seen(got, "doc_id", "text") == sorted(left, key=repr) and len(left) < len(own)

    first = {}
    for d, t in left:
        w = spaces.findall(t or "")
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    cut = []
    for d, t in left:
        w, gone = spaces.findall(t or ""), set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        cut.append((d, [x for i, x in enumerate(w) if i not in gone]))
    got = stages["substring_dedup"](spark, got, small)
    assert got.columns == names and sorted(((r.doc_id, spaces.findall(r.text or "")) for r in got.collect()), key=repr) == sorted(cut, key=repr) and sum(len(w) for _, w in cut) < sum(len(spaces.findall(t or "")) for _, t in left)

    windows = {}
    for t in bench:
        w = plain.findall((t or "").translate(low))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]))
    clean = []
    for r in got.collect():
        w, hit = plain.findall((r.text or "").translate(low)), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((r.doc_id, r.text))
    done = stages["decontamination"](spark, got, small)
    assert done.columns == names and seen(done, "doc_id", "text") == sorted(clean, key=repr)
    assert {d for d, _ in clean} & {2000, 2001} == set()


def test_awkward_and_empty_tables(spark, small):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty(spark).select(plain), small).count() == 0, name
        out = stage(spark, frame(spark).select(plain), small)
        assert out.count() <= len(rows()), name


def test_run(spark, small):
    assert pipeline.run(spark, small).count() > 0
