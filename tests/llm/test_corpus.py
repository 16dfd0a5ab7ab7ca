"""Operators over the whole corpus against brute force, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelmill.llm import common, near_duplicates, quality_classifier, quality_rules, repeated_passages, sharding, shared_keys

KIND = "doc_id long, text string, n bigint, rid string"


def corpus(seed=3):
    """Copies, near copies, shared lines, repeats inside a text, junk and odd characters."""
    pick = random.Random(seed)
    words = [f"w{k}é" if k % 9 == 0 else f"w{k}" for k in range(4000)]
    base = [" ".join(pick.choices(words, k=pick.randint(6, 220))) for _ in range(60)]
    line = " ".join(pick.choices(words, k=25))
    out = [(i, t, i, "x") for i, t in enumerate(base)]
    for i in range(60, 150):
        some = pick.choice(base).split()
        for _ in range(pick.choice([0, 1, 1, 3, 9])):
            some[pick.randrange(len(some))] = pick.choice(words)
        text = " ".join(some)
        out.append((i, text + "\n" + line if i % 3 == 0 else text * 2 if i % 7 == 0 else text, i, "x"))
    hot = base[0].split()
    for i in range(150, 230):  # more near copies than a token may have to be rare
        some = list(hot)
        some[pick.randrange(len(some))] = f"new{i}"
        out.append((i, " ".join(some), i, "x"))
    return [*out, (300, None, 1, "x"), (301, "", 1, "x"), (302, " \n", 1, "x"), (303, "a b", 1, "x"), (304, "A  b", 1, "x"),
            (305, "z" * 400, 1, "x"), (306, "z" * 300, 1, "x"), (5, base[5], 5, "x"), (None, base[5], 5, "x")]


def brute_components(rows):
    sets = {}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= (label[a], label[b]) != (least, least)
            label[a] = label[b] = least
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_components_match_brute_force(spark):
    rows = corpus()
    want = brute_components([r for r in rows if r[0] is not None])
    for rounds in (0, 8):
        got = near_duplicates.near_duplicates(spark.createDataFrame(rows, KIND), rounds=rounds).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert near_duplicates.near_duplicates(spark.createDataFrame([], KIND)).count() == 0


def test_no_pair_of_texts_that_share_too_little_is_compared(spark, monkeypatch):
    common = " ".join(f"c{k}" for k in range(150))
    rows = [(i, common + "".join(f" own{i}x{k}" for k in range(42)), i, "x") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end", i, "x") for i in range(3)]
    compared, saved = [], near_duplicates.saved

    def watched(df):
        out = saved(df)
        compared.extend([out.count()] if out.columns == ["a", "b"] else [])
        return out

    monkeypatch.setattr(near_duplicates, "saved", watched)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert sum(compared) <= 15  # among the six that link; the others share a passage of all


def family(n, edits):
    """A stock text and its variants, by number of words replaced; variants share the new words."""
    rng = np.random.default_rng(7)
    stock = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(stock), 0, "x")]
    for i in range(1, n):
        words = list(stock)
        for at in rng.choice(len(words), edits[i % len(edits)], replace=False):
            words[at] = f"new{rng.integers(3)}"
        rows.append((i, " ".join(words), i, "x"))
    return rows


def test_large_family_is_indexed_by_pieces_of_frequent_tokens(spark):
    rows = family(260, (1, 2, 9))
    index, kept = [], near_duplicates._linked

    def watched(some, *rest):
        index.append(some.count())
        return kept(some, *rest)

    near_duplicates._linked = watched
    try:
        got = near_duplicates.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    finally:
        near_duplicates._linked = kept
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert index[0] < 80 * len(rows)  # pairs of frequent tokens made 140 a document


def test_linked_sets_of_frequent_or_rare_tokens_share_a_signature_in_reach():
    rng = np.random.default_rng(3)
    linked = 0
    for size in (4, 5, 9, 12, 30, 31, 80, 146, 400):
        universe = rng.integers(1, 2**48, 2 * size).astype(np.uint64)
        often = rng.random(len(universe)) < 0.97
        for _ in range(200):
            one = universe[:size]
            keep = rng.random(size) > rng.uniform(0, 0.15)
            two = np.concatenate((one[keep], rng.choice(universe[size:], rng.integers(0, size // 5 + 1), replace=False)))
            both = len(np.intersect1d(one, two))
            if not len(two) or 100 * both < 80 * (len(one) + len(two) - both):
                continue
            linked += 1
            df = dict(zip(universe.tolist(), np.where(often, 1000, 5).tolist(), strict=True))
            held = set(one.tolist()) & set(two.tolist())
            sigs = []
            for tokens, other in ((one, len(two)), (two, len(one))):
                tokens = np.sort(tokens)
                # Frequent tokens are held by many; a rare one may be this set's alone.
                counts = np.array([df[t] if df[t] > 32 or t in held else 1 for t in tokens.tolist()])
                found, reach = near_duplicates.signatures(tokens, counts)
                sigs.append(set(found[reach >= other].tolist()))
            assert sigs[0] & sigs[1]
    assert linked > 500


def test_late_bridge_between_components_of_one_lot(spark):
    lots = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(near_duplicates.PIVOTS)).alias("lot")).collect()
    second = next(i for i in range(100, 900) if lots[i].lot == lots[0].lot)

    def text(changed):
        return " ".join(f"new{k}" if k % 15 == 7 and k // 15 < changed else f"w{k}" for k in range(200))

    # The last document of either component lies between them; as the largest id it is no early pivot.
    some = [(k, 0) for k in range(30)] + [(second + k, 12) for k in range(30)]
    some = [(i, text(4 if i == 29 else 8 if i == second + 29 else n)) for i, n in some]
    rows = [(10_000 + i if i in (29, second + 29) else i, t, i) for i, t in some]
    index = [(sig, i, 196, doc_id) for doc_id, _, i in rows for sig in (1, 2 if i < 100 else 3)]
    texts = spark.createDataFrame([(i, t.encode()) for _, t, i in rows], "rid long, text binary")
    got = near_duplicates._linked(spark.createDataFrame(index, "sig long, rid long, n long, doc_id long"), texts, 8).collect()
    want = brute_components([(i, t) for _, t, i in rows])
    assert {r.node: r.component for r in got} == {i: label for i, (_, label) in want.items()}
    assert len({label for _, label in want.values()}) == 1
    assert len({label for _, label in brute_components([(i, t) for _, t, i in rows if i != 29]).values()}) == 2


def test_short_near_copies_with_unlike_numbers_of_near_tokens_link(spark):
    """One of a pair may have too few near tokens to be judged by them, and the other enough."""
    pick = random.Random(12)
    rows = []
    for i in range(0, 300, 2):
        words = [f"v{pick.randrange(10**6)}" for _ in range(pick.randint(8, 24))]
        rows += [(i, " ".join(words), i, "x"), (i + 1, " ".join([*words, f"end{i}"]), i, "x")]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, KIND)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_few_texts_travel_besides_those_asked_for(spark):
    texts = spark.range(40_000).select((F.xxhash64("id")).alias("rid"), F.encode(F.col("id").cast("string"), "UTF-8").alias("text"))
    asked = texts.filter(F.pmod("rid", F.lit(20)) == 3).select("rid")
    want = {r.rid for r in asked.collect()}
    some = [r.rid for r in near_duplicates._maybe_asked(texts, asked).collect()]
    assert want <= set(some) and len(some) == len(set(some)) and len(some) < len(want) + 40_000 / 10
    got = {r.rid for r in near_duplicates._token_sets(texts.unionByName(texts), asked).collect()}
    assert got == want and near_duplicates._token_sets(texts, asked.filter("rid is null")).count() == 0


def brute_kept(rows):
    seen, out = set(), {}
    for i, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, np.int64)
        mine = [data[p : p + 50] for p in range(len(data) - 49)]
        for p, w in enumerate(mine):
            if w in seen:
                covered[p] += 1
                covered[p + 50] -= 1
        gone = np.cumsum(covered)[: len(data)] > 0
        out.setdefault(i, (len(data), int(gone.sum()), hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
        seen.update(mine if i != 5 else ())
    return out


def test_repeated_bytes_match_brute_force(spark):
    rows = corpus()
    # A document and its repeated row have one id, so neither is the other's earlier document.
    want = brute_kept([r for r in rows if r[0] != 5])
    got = repeated_passages.removal_digests(spark.createDataFrame([r for r in rows if r[0] != 5], KIND).repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None} == want
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    twice = [(5, "q" * 10 + "abcdefghij" * 9, 1, "x")] * 2
    assert [r.n_removed for r in repeated_passages.removal_digests(spark.createDataFrame(twice, KIND)).collect()] == [0, 0]
    assert repeated_passages.removal_digests(spark.createDataFrame([], KIND)).count() == 0


def test_text_is_cut_in_whole_characters(spark):
    text = "é" * 30 + "abc"
    assert repeated_passages.kept_text(text, [(1, 6)]) == "é" * 28 + "abc"
    rows = spark.createDataFrame([(1, "0" + text, 1, "x"), (2, "1" + text, 2, "y"), (3, text, 3, "z"), (4, None, 4, "z")], KIND)
    kept = {r.doc_id: (r.text, r.rid) for r in repeated_passages.without_repeats(rows).collect()}
    assert kept == {1: ("0" + text, "x"), 2: ("1", "y"), 4: (None, "z")}


def test_shards_are_even_and_keep_groups_together(spark):
    texts = [f"text {i}" for i in range(200)] + [f"copy {i % 12}" for i in range(60)] + ["hot"] * 150 + [None, None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_documents(rows, 8).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(texts) and sizes.max() - sizes.min() <= 1 and len(sizes) == 8
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    got["text"] = [texts[i] for i in got.doc_id]
    spread = got.groupby("text").shard.nunique()
    assert spread["hot"] <= 4 and (spread.drop("hot") > 1).sum() <= 2
    assert sharding.shard_documents(rows.limit(0), 8).count() == 0


def test_shards_of_a_table_in_which_every_text_has_a_copy(spark):
    for texts, apart in ([f"text {i % 100}" for i in range(200)], 8), (["hot"] * 80 + [f"text {i % 60}" for i in range(120)], 12):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sharding.shard_documents(rows, 8).toPandas()
        sizes = got.groupby("shard").size()
        assert len(got) == len(texts) and sorted(sizes) == [25] * 8
        got["text"] = [texts[i] for i in got.doc_id]
        spread = got.groupby("text").shard.nunique()
        assert (spread.drop("hot", errors="ignore") > 1).sum() <= apart and spread.get("hot", 1) <= 5


def test_flows_fill_rooms_and_close_cycles():
    pick = np.random.default_rng(1)
    for n in (1, 2, 5, 12):
        for _ in range(20):
            asked, room = pick.integers(0, 4, (n, n)) * (pick.random((n, n)) < 0.4), pick.integers(0, 3, n).tolist()
            np.fill_diagonal(asked, 0)
            flow = sharding.flows(asked, room)
            free = np.array(room) - flow.sum(0) + flow.sum(1)
            assert (flow >= 0).all() and (flow <= asked).all() and (free >= 0).all()
            assert not (asked - flow)[:, free > 0].any()  # nobody waits for a shard with room
    assert sharding.flows(np.array([[0, 2, 0], [0, 0, 3], [4, 0, 0]]), [0, 0, 0]).tolist() == [[0, 2, 0], [0, 0, 2], [2, 0, 0]]


def test_classifier_holds_out(spark, small):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    path = F.concat_ws("/", "source", "lang")
    train, held = labels.filter("doc_id % 5 > 0"), labels.filter("doc_id % 5 = 0")
    got = quality_classifier.classified(docs, train, F.col("source"), path, least_rows=4).join(held, "doc_id").collect()
    right = [r.kept == (r.quality == 1 and r.toxic == 0) for r in got]
    assert len(right) > 50 and sum(right) / len(right) > 0.85
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en"), (2, "", "s", "en")], "doc_id long, text string, source string, lang string")
    assert [r.kept for r in quality_classifier.classified(odd, labels.limit(0), F.col("source"), path).collect()] == [True] * 3
    assert quality_classifier.classified(odd.limit(0), train, F.col("source"), path).count() == 0


def test_quality_stage_finds_toxic_texts_of_every_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.filter("doc_id % 5 > 0"), labels.filter("doc_id % 5 = 0")
    known = docs.join(held, "doc_id")
    blocked, repeated = quality_rules.blocked_stems(docs, train), quality_rules.repeated_stems(docs, train)
    bits = quality_rules.mask_of(["blocked_stems", "repeated_stems"])
    rows = quality_rules.ledger(known, blocked, repeated=repeated).select("lang", "toxic", F.col("failures").bitwiseAND(bits).alias("bits"))
    got = rows.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("bits") > 0, 1)).alias("hit")).collect()
    print(sorted((r.lang, r.toxic, r.hit, r.n) for r in got))
    for r in got:
        assert r.hit >= 0.9 * r.n if r.toxic else r.hit <= 0.05 * r.n, r
    assert len({r.lang for r in got if r.toxic}) == 4
    assert quality_rules.repeated_stems(docs, labels.limit(0)) == {}


def test_repeated_stems_count_words(spark):
    texts = ["Abcd abcde x", "abcd", "xabcd abcd", "wxyzz", "wxyz", None, ""]
    rows = spark.createDataFrame([(i, t, "a" if i < 6 else None) for i, t in enumerate(texts)] + [(9, texts[0], "b")], "doc_id long, text string, lang string")
    got = quality_rules.ledger(rows, repeated={"a": [("abcd", 2), ("wxyzz", 1)], "": [("abcd", 1)]}).collect()
    assert {r.doc_id: r.n_repeated_stems for r in got} == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 9: 0}


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 500)], "a long, b long")
    got = {r.node: r.component for r in common.components(links).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 400: 400, 500: 400}


def test_pipeline_hands_on_its_decisions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.saved(stage(spark, docs, small))
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= docs.count() <= n
        assert stage(spark, docs.limit(0), small).count() == 0
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_flush_holds_what_its_numbers_can_name(spark):
    """Some long texts so that a flush ends in mid-batch, then many short ones in the same task."""
    def keys_of(texts):  # the numbers of a text
        each = [[int(k) << 16 for k in t.split()] for t in texts]
        return np.array([k for e in each for k in e], np.uint64), np.repeat(np.arange(len(each)), [len(e) for e in each]), None

    texts = [" ".join(str(10**6 + 200_000 * i + k) for k in range(180_000)) for i in range(6)]  # over FLUSH_KEYS keys
    texts += [str(i % 35_000) for i in range(70_000)]  # every key in two documents
    rows = spark.createDataFrame(pd.DataFrame({"rid": range(len(texts)), "text": [t.encode() for t in texts]})).coalesce(1)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for size in (10_000, 100_000):
        spark.conf.set(conf, size)
        try:
            found = shared_keys.shared_keys(rows, keys_of).select("rid", "key").toPandas()
        finally:
            spark.conf.unset(conf)
        assert sorted(zip(found.rid, found.key, strict=True)) == [(i + 6, i % 35_000) for i in range(70_000)]


def test_packed_numbers_come_back():
    for kind, values in (("<i8", [-1, 0, 2**62, -(2**63)]), ("<u4", [0, 1, 2**32 - 1]), ("<u2", [65535]), ("u1", [80, 50]), ("<u4", [])):
        back = repeated_passages._numbers(repeated_passages._planes(np.array(values, np.int64), kind), kind)
        assert back.tolist() == values
