"""Operators on documents against brute force, over all awkward cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagefold.llm import classifier, contamination, language, licenses, near, pieces, rules, substrings
from pagefold.llm.common import plain_words, rolling

from .cases import empty, frame, prose, rows, seen

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ws(t):
    return SPACES.findall(t or "")


def pw(t):
    return PLAIN.findall((t or "").translate(LOW))


def test_rules(spark):
    def brute(t):
        w, t = ws(t), t or ""
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if ws(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)

    got = rules.judge(frame(spark)).collect()
    want = sorted((r[0] if r[0] is not None else -1, *brute(r[1])) for r in rows())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert any(r.kept for r in got)
    assert rules.judge(empty(spark)).count() == 0
    plan = rules.judge(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_substrings(spark):
    def brute(width):
        first = {}
        for d, t, *_ in rows():
            w = ws(t)
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                if d is not None:
                    first[k] = min(d, first.get(k, d))
        out = []
        for d, t, *_ in rows():
            w, gone = ws(t), set()
            for i in range(len(w) - width + 1):
                if d is not None and first[tuple(w[i : i + width])] < d:
                    gone.update(range(i, i + width))
            kept = " ".join(x for i, x in enumerate(w) if i not in gone)
            out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        return sorted(out, key=repr)

    for width in (50, 3):
        got = substrings.removal_digest(frame(spark), width)
        assert seen(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute(width)
        assert all(r.n_removed == sum(s["last"] - s["first"] for s in r.spans) for r in got.collect())
    assert substrings.removal_digest(empty(spark)).count() == 0
    cut = substrings.dedup_substrings(frame(spark))
    assert cut.columns == frame(spark).columns and cut.count() == len(rows())
    kept = sorted((r.doc_id if r.doc_id is not None else -1, hashlib.sha256(" ".join(ws(r.text)).encode()).hexdigest()) for r in cut.collect())
    assert kept == sorted((d if d is not None else -1, h) for d, _, _, h in brute(50))
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def test_blocks_hold_about_as_many_bytes_each(spark):
    from pagefold.llm import common

    ids = [*range(0, 900, 3), 1 << 61, -(1 << 61), *range(10**12, 10**12 + 200), None]
    docs = [(x, "c") for x in ids] + [(5, f"hot {k}") for k in range(300)] + [(700 + k, "long " * 130) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    weigh = lambda r: len(r.text) + common.ROW_BYTES
    for ranges in (1000, 8):
        got, total = common.blocks(df, ["doc_id", "text"], 650, ranges)
        rows_ = got.collect()
        assert total == sum(weigh(r) for r in rows_ if r.doc_id is not None) and all((r.doc_id is None) == (r["__g"] is None) for r in rows_)
        known = sorted((r.doc_id, r["__g"] >> common.SUB) for r in rows_ if r.doc_id is not None)
        assert [g for _, g in known] == sorted(g for _, g in known)
        sizes = Counter()
        for r in rows_:
            if r.doc_id is not None:
                sizes[r["__g"]] += weigh(r)
        assert max(sizes.values()) <= (3000 if ranges == 1000 else 10_000) and len(sizes) > 60
        if ranges == 1000:
            assert len({r["__g"] for r in rows_ if r.doc_id == 5}) > 10  # a hot doc_id is no one block
    assert common.blocks(empty(spark), ["doc_id"])[0].count() == 0
    got, total = common.hash_blocks(df, (650, 650))
    sizes = Counter()
    for r in got.collect():
        sizes[r["__g"]] += weigh(r)
    assert sum(sizes.values()) == total and max(sizes.values()) < 3000


def test_messages_grow_with_the_corpus_only():
    """Blocks times buckets: messages stay long."""
    from pagefold.llm import common

    def messages(total):
        return -(-total // common._between(total, common.BLOCK_BYTES)) * common.buckets_for(total // 6)

    for gb, keys in ((0.1, 250), (1, 250), (10, 250), (100, 250), (1000, 40)):
        assert gb * 1e9 / 6 / messages(int(gb * 1e9)) >= keys, gb
    for total in (10**10, 10**13):
        assert common._between(total, common.BLOCK_BYTES) <= 32 << 20


def test_substrings_of_a_hot_doc_id_and_clashing_names(spark, monkeypatch):
    """A doc_id of many texts is dealt over blocks, which are not earlier than each other."""
    from pagefold.llm import common

    monkeypatch.setattr(common, "BLOCK_BYTES", (2000, 2000))
    shared = prose(41, 60)
    docs = [(9, f"{shared} {prose(100 + k, 20)}", k) for k in range(30)] + [(20, f"{prose(42, 10)} {shared}", 99), (3, prose(43, 80), 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __g long")
    got = {(r.doc_id, r["__g"]): r.text for r in substrings.dedup_substrings(df).collect()}
    assert got == {(d, g): t if d != 20 else prose(42, 10) for d, t, g in docs}


def test_rolling_hash_tells_windows_apart():
    v = np.array([5, 6, 7, 5, 6, 7, 6, 5], np.uint64)
    h = rolling(v, 3)
    assert len(h) == 6 and h[0] == h[3] and len(set(h.tolist())) == 5
    assert len(rolling(v, 9)) == 0


def test_distinct_keys():
    from pagefold.llm.common import Distinct, distinct

    r = np.random.default_rng(8)
    near_ = (r.integers(0, 4, 500).astype(np.uint64) << np.uint64(40)) | r.integers(0, 4, 500).astype(np.uint64)  # differ in their last bits
    for keys in (r.integers(0, 1 << 63, 1000).astype(np.uint64), np.repeat(r.integers(0, 1 << 63, 40).astype(np.uint64), 7), near_, near_[:1], near_[:0]):
        u, inverse = distinct(keys)
        assert (u == np.unique(keys)).all() and (u[inverse] == keys).all()
        found, mask = Distinct(keys), np.arange(len(keys)) % 3 == 0
        assert (found.u == u).all() and (found.spread(u) == keys).all()
        assert found.count(mask).tolist() == [int((keys[mask] == x).sum()) for x in u]


def test_word_hashes(monkeypatch):
    from pagefold.llm import common

    for at_once in (1 << 18, 7):
        monkeypatch.setattr(common, "HASHED_AT_ONCE", at_once)
        raw = [None if r[1] is None else r[1].encode() for r in rows()]
        for fold in (False, True):
            h, n = common.hashed(raw, fold)
            split = [(common.lower(t) if fold else t or b"").split() for t in raw]
            assert n.tolist() == [len(x) for x in split]
            pairs = set(zip(h.tolist(), (w for x in split for w in x)))
            assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert common.hashed([])[0].size == 0 and common.windows(h, n, 5)[1].tolist() == [max(0, len(x) - 4) for x in split]


def _components(docs):
    sets = {}
    for d, t, *_ in docs:
        w = ws((t or "").translate(LOW))
        sets.setdefault(d, []).append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    nodes = [(d, s) for d, ss in sets.items() if d is not None for s in ss]
    parent = list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(nodes):
        for j in range(i):
            b = nodes[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(nodes):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, len(s), low[find(i)] if s else d) for i, (d, s) in enumerate(nodes))


@pytest.mark.parametrize("caps", [(None, None), (2, 1 << 30), (5, 3000)])
def test_near_duplicates(spark, caps):
    got = near.near_duplicates(frame(spark), *caps).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == _components(rows())
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert sum(r.doc_id is None for r in got) == 2
    if caps == (None, None):
        assert near.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_chains(spark):
    """Each text is linked with its neighbours only; large groups are dealt out."""
    base = [f"w{k}" for k in range(160)]
    docs = [(100 - k, " ".join(base[4 * k : 4 * k + 60])) for k in range(25)] + [(200 + k, " ".join([*base[:59], f"z{k}"])) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = _components(docs)
    for caps in ((None, None), (4, 1 << 30)):
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(df, *caps).collect()) == want


def test_keep_first_keeps_texts_that_share_a_doc_id(spark):
    a, b = prose(31, 60), prose(32, 60)
    docs = [(1, a, 0), (5, a, 1), (5, b, 2), (5, b, 2), (None, a, 3), (7, None, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __id long")
    assert sorted((tuple(r) for r in near.keep_first(df).collect()), key=repr) == sorted((x for x in docs if x[2] != 1), key=repr)


def test_near_duplicates_at_another_similarity(spark):
    """Pairs on both sides of 80 %: of 100 shingles, 5 k differ."""
    docs = []
    for k in range(1, 7):
        own = [f"a{k}_{j}" for j in range(104)]
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: 104 - 2 * k - 4] + [f"b{k}_{j}" for j in range(2 * k + 4)]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for x, y in zip(docs[::2], docs[1::2]):
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x[1].split(), y[1].split()))
        want[x[0]] = 100 * len(s & t) >= 80 * len(s | t)
    assert 0 < sum(want.values()) < 6
    got = {r.doc_id: r.component_id for r in near.near_duplicates(df, percent=80).collect()}
    assert {d: got[d + 1] == d for d in want} == want


def test_bands_find_pairs_at_the_threshold():
    """Of pairs just above the threshold nearly all share a band and pass the sketch."""
    r = np.random.default_rng(7)
    for percent in (80, 85):
        rows_, found = near.band_rows(percent), 0
        for _ in range(400):
            both = r.integers(0, 1 << 63, 400).astype(np.uint64)
            m = int(400 * (100 - percent) / (100 + percent))
            a, b = (np.unique(np.concatenate((both[: 400 - m], r.integers(0, 1 << 63, m).astype(np.uint64)))) for _ in range(2))
            mins = near.minhash([a, b])
            keys, s = near.band_keys(mins, rows_), near.odd_sketch(mins)
            found += bool((keys[0] == keys[1]).any()) and int(np.bitwise_count(s[0] ^ s[1]).sum()) <= near.most_bits(percent)
        assert found >= 0.99 * 400


def test_components(spark, monkeypatch):
    """Chains, hubs and repeated links, dealt over many tasks."""
    r = np.random.default_rng(3)
    chain, hub = r.permutation(300), 1000
    pairs = [(int(x), int(y)) for x, y in zip(chain, chain[1:])] + [(k, k + 1) for k in range(400, 600)] + [(hub, 1001 + k) for k in range(500)] + [(2000 + k, 1400 + k) for k in range(50)]
    pairs += pairs[:50]
    parent = {v: v for p in pairs for v in p}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for x, y in pairs:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    links = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long").repartition(16)
    for at_once in (1 << 20, 4):
        monkeypatch.setattr(near, "LINKS_AT_ONCE", at_once)
        got = near.components(links).collect()
        assert sorted((x.id, x.label) for x in got) == sorted((v, find(v)) for v in parent)
    assert near.components(links.limit(0)).count() == 0


def test_odd_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    errors = []
    for overlap in (0.85, 0.9, 0.97):
        for _ in range(30):
            both = r.integers(0, 1 << 63, 1000).astype(np.uint64)
            m = int(1000 * (1 - overlap) / (1 + overlap))
            a, b = (np.unique(np.concatenate((both[: 1000 - m], r.integers(0, 1 << 63, m).astype(np.uint64)))) for _ in range(2))
            s = near.odd_sketch(near.minhash([a, b]))
            x = int(np.bitwise_count(s[0] ^ s[1]).sum())
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert x <= near.MOST
            estimate = 1 + near.BITS / (4 * near.SAMPLES) * math.log(1 - 2 * x / near.BITS)
            errors.append(abs(estimate - j))
    assert np.mean(errors) < 0.03


BENCH = [(1, prose(3, 70)), (2, prose(21, 30)), (3, "a b c d e f"), (4, None), (5, ""), (10, prose(3, 20)), (2, prose(21, 30)), (7, "漢字"), (8, prose(8, 40))]


@pytest.mark.parametrize("part", [2_000_000, 40])
def test_decontamination(spark, part):
    windows = {}
    for i, t in BENCH:
        w = pw(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = []
    for d, t, *_ in rows():
        w, hit, items = pw(t), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    items |= ids
        want.append((d, len(w), len(hit), tuple(sorted(map(str, items))), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(BENCH, "item_id long, text string").coalesce(1)
    got = contamination.judged(contamination.find_passages(frame(spark), bench, part_words=part)).collect()
    assert sorted(((r.doc_id, r["__n_words"], r.n_hit, tuple(r["__items"]), r.contaminated) for r in got), key=repr) == sorted(want, key=repr)
    kept = contamination.drop_contaminated(frame(spark), bench)
    assert kept.columns == frame(spark).columns and kept.count() == sum(not x[-1] for x in want)
    assert contamination.find_passages(empty(spark), bench).count() == 0
    none = contamination.judged(contamination.find_passages(frame(spark), bench.limit(0)))
    assert none.filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("part", [2_000_000, 10])
def test_decontamination_edges(spark, part):
    """An item without item_id, one phrase in every document, and columns named like the operator's own."""
    item, other = prose(51, 20), prose(52, 14)
    docs = [(k, f"{prose(200 + k, 5)} {item}", "a", k, 0) for k in range(5)] + [(9, f"{other} {prose(53, 400)}", "b", 1, 1), (9, None, "c", 2, 2), (9, f"{other} {item}", "d", 3, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, __spans string, __items long, n_hit long")
    bench = spark.createDataFrame([("q2", item), ("q1", item), (None, other)], "item_id string, text string").coalesce(1)
    got = contamination.find_passages(df.select("doc_id", "text"), bench, part_words=part).collect()
    assert sorted((r.doc_id, len(r["__spans"]), ",".join(r["__items"])) for r in got) == sorted([(k, 1, "q1,q2") for k in range(5)] + [(9, 1, ""), (9, 0, ""), (9, 1, "q1,q2")])
    kept = contamination.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted((d for d in docs if d[4] in (1, 2)), key=repr)
    assert {r["n_hit"]: r.text for r in contamination.cut_passages(df, bench).collect()}[1] == " " + prose(53, 400)


def test_fm_index():
    r = np.random.default_rng(2)
    t = r.integers(1, 4, 300)
    index = contamination.FMIndex(t.astype(np.int64), 4, 5)
    for n in (1, 2, 3, 6):
        phrases = r.integers(1, 4, (40, n))
        low, high = index.search(phrases, np.full(40, n))
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(300 - n + 1) if (t[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_licenses(spark):
    want = []
    for d, t, *_ in rows():
        w = pw(t)
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want.append((d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    got = licenses.scan(frame(spark))
    assert seen(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got.collect() if r.base_labels)
    assert licenses.scan(empty(spark)).count() == 0


def test_matching_statistics():
    s = licenses.Scanner([("x", "a b c d e f g h"), ("y", "c d e q r")], {"d e": "p", "e f": "q"}, long=3, gap=2, share=0.5)
    text = "a b c d e q r z c d e f g h".split()
    found = s.scan([w.encode() for w in text])
    assert sorted(found["base"]) == [(3, "p"), (9, "p"), (10, "q")]
    assert found["labels"] == ["p", "q", "x", "y"] and found["score"] == 1.0
    whole = licenses.Scanner()
    for label, text in licenses.TEMPLATES:
        cut = text.split()
        if len(cut) < 20:
            continue
        cut[len(cut) // 2] = "other"
        found = whole.scan(plain_words(("before it " + " ".join(cut) + " after").encode()))
        assert label in found["labels"], label


def test_decontamination_cuts_passages(spark):
    """A long document below a twentieth keeps its own words and loses the benchmark's."""
    item = "Which of the seven rivers named here is the longest one, when all are measured by hand?"
    own = " ".join(f"é{k}" for k in range(600))
    docs = spark.createDataFrame([(1, f"{own} ({item}) {own}"), (2, None), (3, own)], "doc_id long, text string")
    benchmark = spark.createDataFrame([("q1", item)], "item_id string, text string")
    assert contamination.drop_contaminated(docs, benchmark).count() == 3
    got = {r.doc_id: r.text for r in contamination.cut_passages(docs, benchmark).collect()}
    assert got == {1: f"{own} (?) {own}", 2: None, 3: own}


def test_matching_statistics_against_all_substrings():
    """Long matches, base places and best chains of random files, from plain comparisons of word lists."""
    r = np.random.default_rng(6)
    for trial in range(60):
        words_ = "abcd"[: 2 + trial % 3]
        draw = lambda n: [str(x) for x in r.choice(list(words_), n)]
        templates = [(f"t{k}", " ".join(draw(r.integers(5, 14)))) for k in range(2)]
        phrases = {" ".join(draw(2)): "p", words_[0]: "q"}
        s = licenses.Scanner(templates, phrases, long=3, gap=2, share=0.5)
        file = draw(30)
        sources = [t.split() for _, t in templates] + [p.split() for p in phrases]
        inside = lambda run: any(src[i : i + len(run)] == run for src in sources for i in range(len(src) - len(run) + 1))
        longest = [max(n for n in range(i + 2) if inside(file[i + 1 - n : i + 1])) for i in range(len(file))]
        want = [(i + 1 - n, i + 1) for i, n in enumerate(longest) if n >= 3 and (i + 1 == len(file) or longest[i + 1] <= n)]
        codes = [s.vocabulary.get(w.encode(), 0) for w in file]
        if 0 in codes:
            continue
        base, matches = s.stream(codes)
        assert [m[:2] for m in matches] == want
        assert sorted((i, phrases[k]) for i, k in ((i, " ".join(x)) for x in map(str.split, phrases) for i in range(len(file)) if file[i : i + len(x)] == x)) == sorted((i, s.phrases[k][1]) for i, k in base)
        for k, (_, text) in enumerate(templates):
            t = text.split()
            found = [(a, b, i) for a, b in want for i in range(len(t)) if t[i : i + b - a] == file[a:b]]
            if not found:
                continue

            def covers(at, done):
                """The most words of a chain that goes on after match ``at``, of which ``done`` were counted before."""
                a, b, i = found[at]
                most = b - a - done
                for j in range(at + 1, len(found)):
                    a2, b2, i2 = found[j]
                    over = max(0, b - a2, i + b - a - i2)
                    if a < a2 and i < i2 and a2 - b <= 2 and i2 - (i + b - a) <= 2 and over < b2 - a2:
                        most = max(most, b - a - done + covers(j, over))
                return most

            assert s._chain(k, found)[0] == max(covers(j, 0) for j in range(len(found)))


def test_license_phrases_of_one_word_and_loaded_templates(spark, tmp_path):
    s = licenses.Scanner([("x", "a b c d e f g h")], {"zzz": "z"})
    assert s.scan([b"one", b"zzz", b"two"])["base"] == [(1, "z")]
    (tmp_path / "Own.txt").write_text("all of these words make up a licence of our own")
    templates = licenses.load_templates(spark, str(tmp_path))
    assert [x for x, _ in templates] == ["own"]
    df = spark.createDataFrame([(1, "/* All of these words make up a licence of our own. */")], "doc_id long, text string")
    assert licenses.scan(df, licenses.Scanner(templates)).first().labels == "own"


def test_licenses_copies():
    """Each copy of a licence text has its spans."""
    scanner = licenses.Scanner()
    label, text = next(x for x in licenses.TEMPLATES if len(plain_words(x[1].encode())) >= 20)
    n = len(plain_words(text.encode()))
    found = scanner.scan(plain_words(f"{text} {'other ' * 300} {text} {'other ' * 300} {text}".encode()))
    words = {w for x, a, b in found["spans"] if x == label for w in range(a, b)}
    for start in (0, n + 300, 2 * (n + 300)):
        assert len(words & set(range(start, start + n))) >= 0.9 * n
    assert len(words) <= 3 * n


def test_flagged_keys():
    """Distinct keys and their flagged places from one sort."""
    from pagefold.llm.common import flagged

    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 5000):
        keys, flags = rng.integers(0, 1 << 63, 400, dtype=np.uint64)[rng.integers(0, 400, n)] << np.uint64(1), rng.random(n) < 0.7
        u, c = flagged(keys, flags)
        assert u.tolist() == sorted(set(keys.tolist()))
        assert c.tolist() == [int(flags[keys == k].sum()) for k in u]


def test_word_hashes_by_length():
    """Words of every length around the eight-byte steps and the change of method, alone and inside a text, the last byte changed too."""
    from pagefold.llm import common

    sizes = [*range(1, 42), *range(120, 140), 1000]
    words = [bytes([97 + k % 5]) * n for n in sizes for k in range(5)] + [b"a" * (n - 1) + b"z" for n in sizes if n > 1]
    h, counts = common.hashed([b" ".join(words)])
    assert counts.tolist() == [len(words)] and len(set(h.tolist())) == len(words)
    alone, _ = common.hashed([b"\n\t " + w + b"\r" for w in reversed(words)])
    assert alone[::-1].tolist() == h.tolist()
    assert common.hashed([b" ".join(words).upper()], fold=True)[0].tolist() == h.tolist()


def test_language_model_places():
    """After the candidates a block needs its bits only, whatever the order of its rows, to find the contexts that its look-up had found."""
    import pyarrow as pa

    from pagefold.llm import common

    rows = [(k % 7, f"w{k % 5} w{k % 3} w{k} a b c d" * (k % 4), False) for k in range(40)] + [(None, None, False), (3, None, False), (3, "", True)]
    shuffled = [rows[k] for k in np.random.default_rng(2).permutation(len(rows))]
    one, two = (language._in_order(pa.Table.from_pylist([dict(zip(("doc_id", "text", "held_out"), r)) for r in x], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("held_out", pa.bool_())]))) for x in (rows, shuffled))
    assert one.equals(two)
    ids = language.Tokens(common.texts(one.column("text")), 4).contexts(2)
    u, n = np.unique(np.concatenate(ids), return_counts=True)
    by = {("often", b): np.packbits(n[i:j] >= 3).tobytes() for b, i, j in common.split_buckets(u, 16)}
    _, ids, found = language._found(one, by, 4, 16)
    _, deep, hits = language._placed(two, {("places", 0): language._bitmap(found)}, 4)
    assert [x.tolist() for x in hits[:2]] == [x.tolist() for x in found] and len(hits) == len(deep) == 4 and 0 < hits[3].sum() < hits[1].sum()
    totals = np.array([0, 9, 254, 0, 255, 300, 1 << 33, 0])
    assert language._all_totals(language._totals(totals), len(totals)).tolist() == totals.tolist()
    assert language._some_totals(language._totals(totals)).tolist() == totals[totals > 0].tolist()
    assert language._some_totals(language._totals(totals[:1])).tolist() == []


def test_language_model_divergence():
    rng = np.random.default_rng(3)
    above = rng.integers(1, 50, (30, 8)).astype(float)
    own = np.floor(above * rng.random((30, 8)) ** 3)
    own[:, 0] = 1
    p, q = own / own.sum(axis=1, keepdims=True), above / above.sum(axis=1, keepdims=True)
    want = (own * np.log(np.where(own > 0, p, q) / q)).sum(axis=1)
    at = np.nonzero(own)
    assert np.allclose(language.divergence(*at, own[at], above), want)


def test_language_model(spark):
    docs = frame(spark)
    got = language.score(docs, None).collect()
    token = lambda t: [*(t or "").translate(LOW).encode().split(), b"\n"]
    train = [token(t) for d, t, *_ in rows() if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    counts = Counter(x for t in train for x in t)
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t, *_ in rows():
        own = token(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own)
        want.append((d, zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2, len(own), sum(counts[x] > 0 for x in own), n, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert language.score(empty(spark)).count() == 0


def test_language_model_contexts(spark):
    """Scores with the retained contexts, recomputed from plain counts."""
    r = np.random.default_rng(1)
    texts = [" ".join(("a b" if x else "c d") if r.random() < 0.9 else "a d" for x in r.integers(0, 2, 60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = language.grow(df.filter(~language.held_out()), share=0.01)
    assert len(tree.contexts) >= 3
    train = [["\r", "\r", *t.split(), "\n"] for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    one, two, zero = Counter(), Counter(), Counter()
    for t in train:
        for u, v, x in zip(t, t[1:], t[2:]):
            zero[x] += 1
            one[v, x] += 1
            two[u, v, x] += 1
    prior = 7.0
    n, distinct = sum(zero.values()), len(zero)
    better = 0.0
    for row in language.score(df, tree, prior).collect():
        t, total, base = ["\r", "\r", *texts[row.doc_id].split(), "\n"], 0.0, 0.0
        tokens = language.Tokens([texts[row.doc_id].encode()])
        c1, c2 = (tree.find(c)[0] for c in tokens.contexts())
        for k, (u, v, x) in enumerate(zip(t, t[1:], t[2:])):
            p = (zero[x] + 1) / (n + distinct + 1)
            base += math.log10(p)
            if c1[k]:
                p = (one[v, x] + prior * p) / (sum(c for (a, _), c in one.items() if a == v) + prior)
            if c2[k]:
                p = (two[u, v, x] + prior * p) / (sum(c for (a, b, _), c in two.items() if (a, b) == (u, v)) + prior)
            total += math.log10(p)
        assert row.score == pytest.approx(total, abs=1e-6) and row.base_score == pytest.approx(base, abs=1e-6)
        better += row.score - row.base_score
    assert better > 0


def test_language_model_grows(spark):
    """A context seen a few times is retained in a large corpus too, and one of three words."""
    filler = " ".join(f"w{k}" for k in range(400_000))
    texts = [filler, *["rare follows"] * 30, *[f"x{k % 4} m m y{k % 4}" for k in range(400)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = language.grow(df)
    deep = language.Tokens([b"rare follows", b"x1 m m y1"], 3)
    one, _, three = (tree.find(c)[0] for c in deep.contexts())
    assert one[1] and three[6]


def test_language_model_retains_what_diverges(spark):
    """The retained contexts of up to four words, from plain counts over word tuples."""
    r = np.random.default_rng(5)
    texts = []
    for _ in range(150):
        out = []
        for _ in range(40):
            out += {0: ["p", "m", "m", "y"], 1: ["q", "m", "m", "z"], 2: ["s", "n", "n", "n", "u"], 3: ["t", "n", "n", "n", "v"], 4: [f"w{r.integers(0, 40)}"]}[int(r.integers(0, 5))]
        texts.append(" ".join(out))
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    depth, least, gain = 4, 8, 4.0
    tree = language.grow(df, gain=gain, least=least, depth=depth)
    counts, ids, tokens = {}, {}, 0
    for text in [*texts, "", ""]:
        t = language.Tokens([text.encode()], depth)
        words = [None] * depth + text.split()
        tokens += len(t.token)
        for p, (x, *own) in enumerate(zip(t.token.tolist(), *t.contexts())):
            for k in range(depth + 1):
                key = tuple(words[depth + p - k : depth + p])
                counts.setdefault(key, Counter())[x % 64] += 1
                if k:
                    ids[key] = int(own[k - 1])
    kept = set()
    for key, own in counts.items():
        n, above = sum(own.values()), counts[key[1:]]
        if key and n >= least:
            d = sum(c * math.log(c / n / (above[x] / sum(above.values()))) for x, c in own.items())
            if d - 63 / 2 >= gain:
                kept |= {key[k:] for k in range(len(key))}
    assert {len(k) for k in kept} == {1, 2, 3, 4}
    assert sorted(tree.contexts.tolist()) == sorted(ids[k] for k in kept)
    assert tree.tokens == tokens and tree.distinct == len({w for t in texts for w in t.split()}) + 1
    assert {int(np.uint64(r.context & (2**64 - 1))): r.total for r in tree.kept.collect()} == {ids[k]: sum(counts[k].values()) for k in kept}


def test_classifier(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = classifier.classify(docs, labels)
    both = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in both)
    assert np.mean([r.predicted == r.quality for r in both if not r.held_out]) > 0.97
    assert np.mean([r.predicted == r.quality for r in both if r.held_out]) > 0.85
    awkward = classifier.with_scores(frame(spark).drop("__score"), classifier.Network()).collect()
    assert len(awkward) == len(rows()) and all(0 <= r["__score"] <= 1 for r in awkward)


def test_classifier_edges(spark):
    docs = frame(spark).drop("__score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.classify(docs, none).collect()} == {0.5}
    assert classifier.classify(docs, none).count() == len(rows()) and classifier.classify(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (6, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.classify(docs, one).collect()} == {1.0}
    assert classifier.keep_good(docs, one).columns == docs.columns


def test_classifier_keeps_columns_of_its_own_names(spark):
    one = spark.createDataFrame([(3, 1), (6, 1)], "doc_id long, quality int")
    assert seen(classifier.keep_good(frame(spark), one), *frame(spark).columns) == seen(frame(spark), *frame(spark).columns)


def test_classifier_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"{'x' if k % 2 else 'y'} " * 50) for k in range(60)] + [(7, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    seen_by = []

    class Spy(classifier.Network):
        def fit(self, raw, label):
            seen_by.append((len(raw), sum(map(len, raw))))
            return self

    old, classifier.Network = classifier.Network, Spy
    try:
        classifier.train(docs, labels, 20)
        classifier.train(docs, labels, 20, 1000)
    finally:
        classifier.Network = old
    assert seen_by[0][0] == 20 and 8 <= seen_by[1][0] <= 11 and seen_by[1][1] <= 1000


def test_classifier_against_plain_loops():
    """The network of every awkward text, one window at a time; and long texts in slices."""
    n = classifier.Network(seed=2)
    p = {k: v.astype(np.float64) for k, v in n.p.items()}
    n.p = p
    raw = [(r[1] or "").encode() for r in rows()]

    def brute(x):
        cells = [x[k : k + 4].ljust(4, b"\0") for k in range(0, len(x), 4)]
        cells += [b"\0" * 4] * (2 - len(cells))
        windows = [np.concatenate([p["embed"][b] for b in u]) @ p["near"] + np.concatenate([p["embed"][b] for b in v]) @ p["far"] for u, v in zip(cells, cells[1:])]
        pieces = max(1, len(windows) // classifier.CHUNK)
        edges = [k * len(windows) // pieces for k in range(pieces + 1)]
        h = [np.maximum(np.max(windows[a:b], axis=0) + p["shift"], 0) for a, b in zip(edges, edges[1:])]
        x = np.concatenate((np.max(h, axis=0), np.min(h, axis=0), np.mean(h, axis=0), [min(1.0, len(windows) / classifier.CHUNK)]))
        return 1 / (1 + math.exp(-float(np.maximum(x @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"][0])))

    want = [brute(x) for x in raw]
    for size in (1 << 20, 700):
        assert n.score(raw, size) == pytest.approx(want, abs=1e-6)
    assert [n.score_long(x, 600) for x in raw] == pytest.approx(want, abs=1e-6)


def test_classifier_gradients():
    n = classifier.Network(seed=1)
    for k in n.p:
        n.p[k] = n.p[k].astype(np.float64)
    raw, y = [prose(1, 300).encode(), b"*** " * 90, b"x", b""], np.array([1.0, 0.0, 1.0, 0.0])
    loss = lambda: float(np.mean([-(math.log(p) if t else math.log(1 - p)) for p, t in zip(n.forward(raw)[0], y)]))
    g = n.gradients(raw, y)
    for name, at in (("w1", (5, 3)), ("w2", (2,)), ("b2", (0,)), ("near", (9, 4)), ("far", (3, 7)), ("shift", (4,)), ("embed", (42, 1)), ("embed", (ord("a"), 2))):
        old, e = n.p[name][at], 1e-4
        n.p[name][at] = old + e
        up = loss()
        n.p[name][at] = old - e
        down = loss()
        n.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-4), name


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    import os

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no model")
    lib, model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load(spark, pieces.MODEL)
    got = pieces.encode(frame(spark), model)
    for r in got.join(frame(spark).select("doc_id", "text").distinct(), "doc_id").filter("doc_id <> -5").collect():
        assert r.ids == (lib.encode(r.text) if r.text else []) and r.n_tokens == len(r.ids)
        assert r.round_trip == ("▁" not in (r.text or ""))
    assert got.count() == len(rows()) and pieces.encode(empty(spark), model).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(got.filter("doc_id >= 0"), model).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t, *_ in rows() if d is not None and d >= 0)


def test_pieces_equal_the_library_on_random_text():
    sentencepiece = pytest.importorskip("sentencepiece")
    import os
    import random

    if not os.path.exists(pieces.MODEL):
        pytest.skip("no model")
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Model(f.read())
    lib, r = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), random.Random(5)
    plain = [p.replace("▁", " ") for p in model.ids]
    for _ in range(1500):
        t = "".join(r.choice(plain) for _ in range(r.randint(0, 7))) if r.random() < 0.5 else "".join(r.choice("aabeehinorstt  \n.é漢​") for _ in range(r.randint(0, 40)))
        assert model.encode([t])[0].tolist() == lib.encode(t)


def test_unigram_search():
    """Viterbi against all segmentations, with a model written by hand."""
    vocab = {"<unk>": 0.0, "▁": -2.0, "a": -2.5, "b": -3.0, "ab": -3.5, "▁a": -3.2, "ba": -4.0, "aba": -5.1, "▁ab": -6.0}

    def field(n, kind, body):
        head = bytes([n << 3 | kind])
        return head + (bytes([len(body)]) + body if kind == 2 else body)

    import itertools
    import struct

    raw = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([2 if p == "<unk>" else 1]))) for p, s in vocab.items())
    raw += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(4, 0, b"\x00"))
    model = pieces.Model(raw)
    for n in range(1, 7):
        for t in itertools.product("ab ", repeat=n):
            text = "".join(t)
            ids = model.encode([text])[0].tolist()
            marked = "▁" + text.replace(" ", "▁")

            def best(s):
                return 0.0 if not s else max((vocab[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in vocab), default=-1e9)

            assert sum(list(vocab.values())[i] for i in ids) == pytest.approx(best(marked), abs=1e-4)
            assert model.decode(ids) == text
