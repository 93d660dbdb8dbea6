"""Collocations, fingerprints and the filter audit against brute force and SQL, on rows with nulls, empties, long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from strandex.llm import collocations, filter_audit, fingerprints, lines, mixing, quality, urls
from strandex.llm.common import KeyFilter

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, rank bigint, phrase string, mask bigint, part string, bucket int, copy boolean, key bigint"


def frame(spark, rows):
    """doc_id, text, lang, source and columns named as those the operators use inside."""
    return spark.createDataFrame([(*r, -1, -1, -1, "x", -1, "p", -1, True, -1) for r in rows], COLUMNS).repartition(5)


def same_as_sql(got, sql):
    names = sql
    for t in ("documents", "labels", "pages"):
        names = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 '{SMALL}/{t}.parquet'", names)
    want = duckdb.sql(names).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].values.tolist()))
    assert rows(got) == rows(want)


# --- 11 -----------------------------------------------------------------------------------------------------------


def brute_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least:
                if len(p) == 2 and any(2 * c[q] >= a for q in c if len(q) == 3 and c[q] >= least and p in (q[:2], q[1:])):
                    continue
                score, k = min((int(Fraction(1_000_000 * a * a, c[p[:k]] * c[p[k:]])), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out[lang, i + 1] = (p.decode(), -a, left, right, n[lang], -s)
    return out


def mined(df, **more):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **more).collect()}


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(11)
    vocab = ["w%d" % i for i in range(40)] + ["Été", "數", "NEW", "new", "York", "'s"]
    rows = [(0, None, "en", None), (1, "", "en", "a"), (2, " \t\n.", None, "a"), (3, ".,;:!?", "", "a"), (None, "lone", "xx", None)]
    for i in range(4, 200):
        w = rng.choices(vocab, [1 / (k + 1) for k in range(len(vocab))], k=rng.randint(1, 60))
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x1f"]) for x in w)
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"]), "s"))
    rows += [(900, "the the the the the the the the the the the the", "de", None), (901, " a b " * 30_000, "long", None), rows[20], rows[20]]
    return rows


def test_collocations_against_brute_force(spark, phrases):
    df = frame(spark, phrases)
    assert mined(df) == brute_collocations(phrases, 10, 2000)
    assert mined(df, least=2, top=25) == brute_collocations(phrases, 2, 25)
    assert mined(df, least=300, top=5) == brute_collocations(phrases, 300, 5)
    assert mined(df.limit(0)) == {}


def test_collocations_with_few_buckets_and_small_blocks(spark, phrases, monkeypatch):
    """Where all phrases share a few buckets nothing is pruned, and nothing changes."""
    monkeypatch.setattr(collocations, "AT_ONCE", 200)
    monkeypatch.setattr(collocations, "PIECES", 2)
    monkeypatch.setattr(collocations, "WORD_BITS", 5)
    monkeypatch.setattr(collocations, "PHRASE_BITS", 6)
    cloudpickle.register_pickle_by_value(collocations)
    try:
        assert mined(frame(spark, phrases)) == brute_collocations(phrases, 10, 2000)
    finally:
        cloudpickle.unregister_pickle_by_value(collocations)


def test_collocation_buckets_prune():
    w = collocations.Words(pa.array(["a b c d a b. c a b c"], pa.large_string()), "en")
    assert w.bytes_of().to_pylist() == "a b c d a b c a b c".split() and w.longer(2).tolist() == [0, 1, 2, 3, 4, 6, 7, 8] and w.longer(3).tolist() == [0, 1, 2, 3, 6, 7]
    counts = np.zeros(1 << collocations.PHRASE_BITS, np.uint8)
    for _ in range(3):
        collocations.add(counts, w.buckets(w.longer(2), 2), 10)
    assert counts[w.buckets(np.array([0]), 2)].tolist() == [9] and counts[w.buckets(np.array([2]), 2)].tolist() == [3]
    other = collocations.Words(pa.array(["a b"], pa.large_string()), "de")
    assert other.hash[0] != w.hash[0]


def test_collocation_scores_are_exact(spark):
    n = 3 * 10**9 + 1
    df = spark.createDataFrame([(n, n, n), (n - 1, n, n), (10, 10**10, 10**10), (10**13, 10**14 + 7, 10**14 + 9)], "a bigint, l bigint, r bigint")
    got = [r.s for r in df.select(collocations.cut_score(df.a, df.l, df.r).alias("s")).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in [(n, n, n), (n - 1, n, n), (10, 10**10, 10**10), (10**13, 10**14 + 7, 10**14 + 9)]]


def test_collocations_sql(spark):
    same_as_sql(collocations.op11_collocations(spark, SMALL), collocations.SQL)


# --- 12 -----------------------------------------------------------------------------------------------------------


def shingles(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in order]
    return [(r[0], t, t[: len(t) - len(t) // 4] + u[: len(t) // 4], u) for r, t, u in zip(order, texts, texts[1:] + texts[:1], strict=True)]


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(12)
    word = lambda: "w%d" % rng.randrange(5000)
    rows = [(-5, "É" * 7, "en", None), (0, None, "en", None), (1, "", "en", None), (2, " \t", "en", None), (3, "one", "en", None), (4, "one two three", "en", None), (5, "A b c d E", "en", None)]
    rows += [(10 + 3 * i, " ".join(word() for _ in range(rng.randint(1, 400))), "en", None) for i in range(150)]
    rows += [(7, rows[30][1].upper(), "en", None), (8, rows[30][1], "en", None), (2**60, "數 é " * 60_000, "en", None), (None, "no id at all", "en", None)]
    return rows


def test_fingerprints_against_brute_force(spark, pages):
    got = sorted((r.asDict() for r in fingerprints.compared(frame(spark, pages)).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = edited(pages)
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == [(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want]
    off = []
    for r, (_, t, e, u) in zip(got, want, strict=True):
        for at, other in (("near_edited", e), ("near_next", u)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert r[at] == true if true in (0.0, 1.0) else 0 <= r[at] <= 1
            if len(a) > 100:
                off.append(r[at] - true)
        a, b = shingles(t), shingles(e)
        if len(a) > 100:
            off.append(r["contained_edited"] - len(a & b) / len(a))
    assert np.abs(off).mean() < 0.06 and np.abs(off).max() < 0.3
    by_text = defaultdict(set)
    for r, (_, t, _, _) in zip(got, want, strict=True):
        by_text[t.upper()].add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len({min(x) for x in by_text.values()}) > 150
    assert fingerprints.compared(frame(spark, pages).limit(0)).count() == 0
    one = fingerprints.compared(frame(spark, [(1, "abcd", None, None)])).first()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abca").hexdigest(), 1.0)


def test_fingerprints_keep_all_below_the_threshold(pages):
    texts = [t or "" for _, t, _, _ in pages]
    for s, every in zip(fingerprints.sketches(pa.array(texts)), fingerprints.sketches(pa.array(texts), scale=1), strict=True):
        low = every[every < (1 << 48) // 8]
        assert s.tolist() == (low if len(low) else every[:1]).tolist() and (np.diff(s.astype(np.int64)) > 0).all()
        assert np.array_equal(fingerprints.from_text(fingerprints.to_text(s)), s) and len(base64.b64decode(fingerprints.to_text(s))) == 6 * len(s)
    sizes = [len(shingles(t)) for t in texts]
    assert [len(s) for s in fingerprints.sketches(pa.array(texts), scale=1)] == sizes


def test_fingerprints_merge():
    rng = random.Random(3)
    texts = [" ".join("w%d" % rng.randrange(50) for _ in range(n)) for n in (5, 6, 8, 40, 300, 2000)]
    every = fingerprints.sketches(pa.array(texts), scale=1)
    for a in range(6):
        for b in range(6):
            both = fingerprints.merge(fingerprints.sketches(pa.array([texts[a], texts[b]])))
            whole = np.union1d(every[a], every[b])
            low = whole[whole < (1 << 48) // 8]
            assert both.tolist() == (low if len(low) else whole[:1]).tolist()
    assert fingerprints.likeness(np.zeros(0, np.uint64), np.zeros(0, np.uint64)) == 1 and fingerprints.containment(np.zeros(0, np.uint64), every[0]) == 1


def test_fingerprint_containment_of_unequal_documents(spark):
    rng = random.Random(5)
    part = [" ".join("p%d" % rng.randrange(10**6) for _ in range(400)) for _ in range(3)]
    rows = [(i, t, "x", "short") for i, t in enumerate(part)] + [(9, " ".join([part[0], *("q%d" % rng.randrange(10**6) for _ in range(20_000)), *part[1].split()[:200]]), "x", "long")]
    prints = fingerprints.fingerprints(frame(spark, rows))
    h = fingerprints.hashes(prints, "doc_id")
    got = {(r.doc_id, r.other): r.containment for r in fingerprints.contained(h.where("doc_id < 9"), "doc_id", h.where("doc_id = 9").withColumnRenamed("doc_id", "other"), "other").collect()}
    assert got[0, 9] == 1 and abs(got[1, 9] - 0.5) < 0.2 and (2, 9) not in got
    merged = fingerprints.hashes(prints.selectExpr("doc_id >= 0 AS all", "fingerprint"), "all")
    assert merged.count() == len(fingerprints.merge(map(fingerprints.from_text, [r.fingerprint for r in prints.collect()])))


def test_fingerprints_of_rows_with_one_id(spark):
    rows = [(1, x, None, None) for x in ("aaaa", "bbbb", "cccc")] + [(2, "dddd", None, None)]
    got = [r.edited_sha256 for r in fingerprints.compared(frame(spark, rows)).collect()]
    every = {hashlib.sha256((a[:3] + b[:1]).encode()).hexdigest() for _, a, _, _ in rows for _, b, _, _ in rows}
    assert len(got) == 4 and len(set(got)) == 4 and set(got) <= every


# --- 13 -----------------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    docs = defaultdict(list)
    for i, t, _, part in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in first and i > first[t]}
        docs[part or ""].append((frozenset(k for k, v in fails.items() if v), i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, held in docs.items():
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                gone = set(order[:k])
                live = [d for d in held if not d[0] & gone]
                removed = [d for d in live if x in d[0]]
                shapley[part, x] += len(removed)
                out[part, order, k + 1] = (len(live) - len(removed), len(removed), sum(x in d[0] for d in held) - len(removed), sum(d[0] == {x} for d in held), sum(d[1] for d in removed), sum(d[2] for d in removed))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(13)
    texts = [None, "", " ", "short #", "\x0b".join(["Word", "word"] * 40), " ".join("u%d" % i for i in range(60)), " ".join("U%d" % i for i in range(60)) + "&", "L " * 30_000 + "|", " ".join("É%d" % i for i in range(50)), " ".join("v%d" % i for i in range(50)) + " $"]
    rows = [(rng.choice([i, i, i, i // 2, None]), rng.choice(texts), None, rng.choice(["a", "a", "a", "b", "", None, "é\n"])) for i in range(160)]
    rows.append((1000, "only one", None, "lonely"))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None, 7])) for i in [*range(0, 150, 2), *range(0, 60, 4), 9999, None]]
    df, known = frame(spark, rows), spark.createDataFrame([(*x, "p", -1) for x in labels], "doc_id bigint, quality int, toxic int, part string, mask int")
    from strandex.llm.common import Scratch

    def audit(df, known):
        rows = filter_audit.audit(filter_audit.histogram(filter_audit.masks(df, Scratch(spark, "test")), known)).collect()
        out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in rows}
        assert len(out) == len(rows)
        return out

    want = brute_audit(rows, labels)
    assert audit(df, known) == want and len(want) == 600 * 5
    assert audit(df, known.limit(0)) == brute_audit(rows, [])
    assert audit(df.limit(0), known) == {}


def test_filter_audit_sql(spark):
    same_as_sql(filter_audit.op13_filter_audit(spark, SMALL), filter_audit.SQL)


# --- 3 ------------------------------------------------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("tail", [40, 6])
def test_lines_that_share_a_passage_make_few_pairs(tail):
    """Of lines that agree in their first 51 code points pairs are written only where counts leave a chance, and all that are close are among them."""
    rng = random.Random(tail)
    start = "".join(rng.choice("abcdefghij ") for _ in range(50)) + "x"
    texts = [start + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(tail)) for _ in range(1500)]
    for i in range(0, 1500, 50):
        texts[i + 1] = texts[i][:-1] + "Q"
    texts = list(dict.fromkeys(texts))
    x = lines.Lines(texts)
    every = KeyFilter(np.full(1 << (KeyFilter.BITS - 6), -1, np.int64))
    out = {}
    for giant in (every, KeyFilter(np.zeros(1 << (KeyFilter.BITS - 6), np.int64))):
        packets, held, pairs = lines.Packets(6, 32, every, every, giant), defaultdict(list), set()
        packets.add(x, np.arange(len(texts)))
        for batch in packets.flush():
            for bucket, packet in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[bucket].append(packet)
        for bucket, packed in held.items():
            pairs |= set(zip(*(p.tolist() for p in lines.Bucket(packed, bucket >> 6).flagged_pairs()), strict=True))
        out[giant] = pairs
        assert (max(held) >> 6 > 0) == (giant is every)
    assert len({frozenset(p) for p in out.values()}) == 1
    short = {int(h) >> 32 & 0xFFFFFFFF: i for i, h in enumerate(x.id.tolist())}
    found = {frozenset((short[a], short[b])) for a, b in out[every]}
    if tail == 40:
        assert len(found) < 3 * len(texts)
    near = {frozenset((i, j)) for i in range(0, len(texts) - 1, 50) for j in range(len(texts)) if i != j and abs(len(texts[i]) - len(texts[j])) <= 4 and distance(texts[i][-tail - 4 :], texts[j][-tail - 4 :]) <= lines.threshold(min(len(texts[i]), len(texts[j])))}
    assert near <= found and near


def test_line_dedup_columns(spark, tmp_path):
    """op3's columns, on a table of its own, against all pairs of lines."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(1, 24))) for _ in range(30)]

    def line():
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice("abcdxyz")
        return rng.choice(["", "  ", "\t"]) + "".join(t) + rng.choice(["", " "])

    rows = [(i, "\n".join(rng.choice([line, line, line, lambda: "", lambda: " \x0b"])() for _ in range(rng.randint(1, 9))), "en", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "", "en", None), (102, " \n ", "en", None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lines.op3_line_dedup(spark, str(tmp_path)).collect()}
    placed = [(i, k, t) for i, text, *_ in rows for k, y in enumerate((text or "").split("\n")) if (t := y.strip(lines.BLANKS))]
    earlier, fate = [], {}
    for i, k, t in placed:
        if t in {e for e in earlier}:
            fate[i, k] = (True, False)
            continue
        near = any(abs(len(t) - len(e)) <= min(len(t), len(e)) // 20 and distance(t, e) <= min(len(t), len(e)) // 20 for e in earlier)
        fate[i, k] = (near, near)
        earlier.append(t)
    # a line that is near to an earlier one is itself what equal lines stand after
    first = {}
    for i, k, t in placed:
        first.setdefault(t, (i, k))
    for i, k, t in placed:
        if first[t] != (i, k):
            fate[i, k] = (True, False)
    for i, *_ in rows:
        own = {k: v for (j, k), v in fate.items() if j == i}
        want = (len(own), sum(v[0] for v in own.values()), sum(v[1] for v in own.values()), ",".join(str(k) for k, v in sorted(own.items()) if v[0]))
        assert (got[i].n_lines, got[i].n_removed, got[i].n_near, got[i].removed_lines) == want, i
    assert len(got) == len(rows) and sum(r.n_near for r in got.values()) > 10


# --- 4 ------------------------------------------------------------------------------------------------------------


def raked(cells, targets, rounds=200):
    """Plain raking of {(source, lang, topic): words}; targets by margin, None for the present shares to the power 0.9."""
    goal = []
    for k, t in enumerate(targets):
        have = Counter()
        for c, n in cells.items():
            have[c[k]] += n
        goal.append(t if t is not None else {v: n**0.9 for v, n in have.items() if n})
    w = {c: 1.0 for c in cells}
    for _ in range(rounds):
        for k, t in enumerate(goal):
            have = Counter()
            for c, n in cells.items():
                have[c[k]] += n * w[c]
            live = {v for v, n in have.items() if n > 0}
            total = sum(t.get(v, 0) for v in live)
            for c in cells:
                if c[k] in live:
                    w[c] *= t.get(c[k], 0) / total * sum(cells.values()) / have[c[k]]
    return w


def test_mixing_against_plain_raking(spark, monkeypatch):
    """Weights on the driver and in rounds of Spark, with and without targets; values without a target get nothing."""
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(4)}", rng.choice(["en", "de", "(none)"]), rng.choice(["short", "long"]), rng.choice([0, 5, 90, 700])) for _ in range(120)]
    cells = Counter()
    for *c, n in rows:
        cells[tuple(c)] += n
    counted = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens bigint")
    monkeypatch.setattr(mixing, "ROUNDS", 40)
    for targets in ({}, {"source": {"s0": 0.5, "s1": 0.5, "s3": 0.0, "absent": 0.4}, "lang": {"en": 0.7, "de": 0.3, "(none)": 0.1}}):
        want = raked(cells, [targets.get(m) for m in mixing.MARGINS], 40)
        for most in (1 << 16, 1):
            monkeypatch.setattr(mixing, "MOST_CELLS", most)
            got = {(r.source, r.lang, r.topic): r.weight for r in mixing.cell_weights(spark, counted, targets)[0].collect()}
            assert got.keys() == want.keys() and all(abs(got[c] - want[c]) <= 1e-6 * max(1, want[c]) for c in want), (targets, most)
            if targets:
                assert all(w == 0 for c, w in got.items() if c[0] in ("s2", "s3")) and any(w > 0 for w in got.values())
    with pytest.warns(UserWarning, match="off by"):
        mixing.rake(np.array([[1.0, 0.0], [0.0, 1.0]]), [np.array([0.9, 0.1]), np.array([0.1, 0.9])], 5)


def test_mixing_columns(spark, tmp_path):
    """op4's columns against plain counting and raking, and the rows that were drawn against the draw itself."""
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "x y\n" * rng.randint(1, 40), " ".join(["word"] * rng.randint(1, 600)), " | ".join(["cell"] * rng.randint(1, 30))]), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(150)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")

    def topic(t):
        return "tabular" if t.count(" | ") >= 8 else "listed" if len(t) < 60 * (t.count("\n") + 1) else "short" if len(t) < 1500 else "long"

    cell = {i: (s or "(none)", lang or "(none)", topic(t or "")) for i, t, lang, s in rows}
    cells = Counter()
    for i, t, *_ in rows:
        cells[cell[i]] += len(WORDS.findall(t or ""))
    w = raked(cells, [None, None, None])
    top = max(w[c] for c in w if cells[c])
    p = {i: min(1.0, w[cell[i]] / top) for i in cell}
    u = {r.doc_id: r.u for r in frame(spark, rows).select("doc_id", mixing.draw(F.col("doc_id")).alias("u")).collect()}
    got = {r.doc_id: r for r in mixing.op4_source_mixing(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in cell if u[i] < p[i]} and 0 < len(got) < len(rows)
    for i, t, *_ in rows:
        if r := got.get(i):
            assert ((r.source, r.lang, r.topic), r.n_tokens) == (cell[i], len(WORDS.findall(t or ""))) and abs(r.weight - w[cell[i]]) < 1e-6 and abs(r.probability - p[i]) < 1e-6


# --- 9, 10: what isn't learned ------------------------------------------------------------------------------------


def test_base_columns_and_rules_sql(spark):
    same_as_sql(quality.quality_base_columns(spark, SMALL), quality.SQL)
    rows = urls.url_rules(spark, SMALL)
    same_as_sql(rows.na.fill("-"), f"SELECT page_id, host, path, coalesce(rule, '-') AS rule, coalesce(by_rule, '-') AS by_rule FROM ({urls.SQL})")
