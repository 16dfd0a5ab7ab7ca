"""Collocations, planned packing and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm import collocations, conversation_trie, planned_packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- collocations ------------------------------------------------------------------------------


def brute_phrases(rows, support, inside, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    out = defaultdict(list)
    for (lang, *words), a in found.items():
        score, _, left, right = min(
            (2_000_000 * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]])
            for k in range(1, len(words))
        )
        holds = lambda other: any(other[i : i + len(words)] == words for i in range(len(other) - len(words) + 1))  # noqa: B023, E731
        if not any(q[0] == lang and len(q) - 1 > len(words) and 100 * b >= inside * a and holds(list(q[1:])) for q, b in found.items()):
            out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -s)
        for lang, some in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(some)[:top], 1)
    }


def phrase_corpus():
    pick = random.Random(5)
    words = ["the", "The", "of", "é", "new", "york", "x" * 3000, "a", "b", "c", "d"]
    rows = []
    for k in range(160):
        some = " ".join(pick.choices(words, weights=[9, 3, 9, 4, 5, 5, 0.1, 3, 3, 3, 3], k=pick.randint(0, 60)))
        text = some + pick.choice([".", ", ", "\n", "\x0b", "\t", "  "]) + "new york times of the day" + pick.choice(["", "!?", " a a a a a"])
        rows.append((pick.choice(["en", "en", "de", "", None]), text))
    return [*rows, ("en", None), ("fr", ""), ("fr", " \t.,"), rows[0], rows[0], ("en", "hot hot hot " * 400), ("en", "nospace" * 500), (None, "é é é " * 9)]


@pytest.mark.parametrize(("parts", "unit"), [(1, 1 << 20), (7, 300), (3, 1)])
def test_phrases_match_brute_force(spark, parts, unit):
    rows = phrase_corpus()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, phrase string").repartition(parts)
    for support, top in ((12, 2000), (3, 25)):
        got = collocations.collocations(docs, support=support, top=top, shards=3, unit_bytes=unit)
        assert {tuple(r) for r in got.collect()} == brute_phrases(rows, support, 80, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_mining_counts_every_phrase_by_48_bits():
    batch = next(iter(collocations._rows([collocations._unit("en", 0, [b"a b c a b"])])))
    every = collocations.Bits(15, np.full(1 << 12, 255, np.uint8))
    (out,) = collocations._local(SimpleNamespace(value=[every]), collocations.Unit(batch, 0))
    keys = out.column("key").to_numpy()
    assert sorted(out.column("n").to_pylist()) == [1, 1, 2] and len(set(keys.tolist())) == 3
    assert not (keys & 0xFFFF).any()


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([("en", None), (None, "")], "lang string, text string")
    for some in (docs, docs.limit(0)):
        assert collocations.collocations(some).count() == 0
    with pytest.raises(ValueError):
        collocations.phrase_counts(docs, 0)


def test_bitmaps_miss_no_member(spark):
    keys = [0, -1, 1 << 62, -(1 << 63), 7, 7 << 40, 12345678901234567]
    bits = collocations.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert bits.has(np.array(keys, np.int64).view(np.uint64)).all()
    assert bits.has(np.random.default_rng(0).integers(1 << 63, size=1000).astype(np.uint64) * np.uint64(2)).mean() < 0.05
    assert not collocations.bitmap(spark.createDataFrame([], "key long")).has(np.array([5], np.uint64)).any()


# --- planned packing ---------------------------------------------------------------------------


def literal_best_fit(lengths, capacity):
    """Number of sequences of best fit, longest first, piece by piece."""
    room = []
    for length in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits)[1]] -= length
        else:
            room.append(capacity - length)
    return len(room), sorted(room)


@given(st.lists(st.integers(1, 40), max_size=300))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_over_counts(lengths):
    plan = planned_packing.plan(Counter(lengths), 40)
    held, used = defaultdict(list), Counter()
    keys = plan.keys()
    seen = Counter()
    for length in lengths:
        rank = seen[length]
        seen[length] += 1
        at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
        assert plan.length[at] == length
        held[int(plan.sequence[at] + rank - plan.rank[at])].append((int(plan.offset[at]), length))
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):  # gapless, apart
            assert offset == end
            end += length
        assert end <= 40
        used[40 - end] += 1
    assert (len(held), sorted(used.elements())) == literal_best_fit(lengths, 40) and plan.sequences == len(held)
    assert len(keys) <= 40 * 41


def test_plan_is_bounded_and_refuses_long_pieces():
    plan = planned_packing.plan({k: 10**12 + k for k in range(1, 1025)})
    assert len(plan.length) < 20_000
    total = sum(k * (10**12 + k) for k in range(1, 1025))
    assert plan.sequences * 1024 < total * (1 + 1e-9)
    with pytest.raises(ValueError):
        planned_packing.plan({1025: 1})


def test_pieces_take_planned_slots(spark):
    from tokenizers import Tokenizer

    machine = Tokenizer.from_file(VOCABULARY)
    texts = [None, "", "a", "word " * 90, "<|endoftext|> é", "x" * 999, "same text", *["same text"] * 40, "the cat " * 700, " \n" * 9]
    rows = [(k if k % 5 else None, t, 0, 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, task int").repartition(5)
    got = planned_packing.packed(docs, VOCABULARY, capacity=64).toPandas()
    cuts = []
    for doc, text, *_ in rows:
        ids = np.array([*machine.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at, length, part = 0, (len(ids) - 1) % 64 + 1, 0
        while at < len(ids):
            cuts.append((doc, part, at, length, zlib.crc32(ids[at : at + length].tobytes())))
            at, length, part = at + length, 64, part + 1
    seen = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert Counter(seen) == Counter(cuts)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    assert got.sequence_id.nunique() == literal_best_fit([c[3] for c in cuts], 64)[0]
    assert planned_packing.packed(docs.limit(0), VOCABULARY).count() == 0


# --- the conversation trie ---------------------------------------------------------------------


def brute_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = [*own.get(base, [])[:h], *turns[h:]]
    return out


def brute_trie(convs):
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    for p, some in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(some) - 1) * words
    return Counter(
        (min(some), len(p), min(members[p[:-1]]) if p else None, len(some), len(kids[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, some in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def chats():
    pick = random.Random(8)
    rows = []
    for c in [*range(-25, 140), *range(4000, 4300)]:
        hot = c > 4100
        for turn in range(3 if hot else pick.choice([1, 2, 2, 3, 5, 9])):
            text = "same words here" if hot or pick.random() < 0.4 else f"words {pick.randrange(40)} é\t!"
            rows.append((c, turn if pick.random() < 0.95 else None, pick.choice(["user", "user", None]) if not hot else "user", text))
    rows += [(77, None, None, None), (77, None, None, None), (None, 1, "user", "lost"), (10_000, 3, "", "")]
    rows += [(9001, k, "user", "deep " * (k % 3)) for k in range(300)] + [(9002, k, "user", "deep " * (k % 3)) for k in range(260)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [8 << 20, 2000, 300])
def test_trie_matches_brute_force(spark, size):
    rows = chats()
    turns = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn int, role string, text string, n int, open boolean")
    got = conversation_trie.trie(turns.repartition(6), slice_bytes=size).select(*COLUMNS).collect()
    assert Counter(tuple(r) for r in got) == brute_trie(brute_rebuilt(rows))


def test_trie_of_nothing_and_of_the_root_alone(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert conversation_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).count() == 0
    # One short conversation whose base is not there loses its turns and is the root alone.
    alone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    (row,) = conversation_trie.trie(spark.createDataFrame([(alone, 0, "user", "x")], kind)).collect()
    assert row[:7] == (alone, 0, None, 1, 0, 1, 0)


def tree_counts(keys):
    """Nodes of a lone slice, without digests."""
    tree = conversation_trie.Slice(0, (0, 0))
    for conv, key in enumerate(keys):
        packed = b"".join(k.to_bytes(conversation_trie.WIDTH, "big") for k in key)
        tree.add(conversation_trie.Key(packed, np.ones(len(key), np.int64), conv, 1, "x"))
    return tree, sorted((r[4], r[3], r[6], r[7], r[8], r[9], r[11] is not None) for r in tree.nodes())


def check_tree(keys):
    tree, got = tree_counts(keys)
    nodes = defaultdict(list)
    for conv, key in enumerate(keys):
        for d in range(len(key) + 1):
            nodes[key[:d]].append(conv)
    want = []
    for p, some in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = sum(len(q) == len(p) + 1 for q in under)
        leaves = sum(not any(len(r) > len(q) and r[: len(q)] == q for r in nodes) for q in under)
        spare = sum(len(nodes[q]) - 1 for q in under if q)
        # The root is open: whether it is a leaf shows only when slices meet.
        want.append((len(p), min(some), len(some), kids, leaves if p or kids else 0, spare, p in keys))
    assert got == sorted(want)
    return tree


ID = st.one_of(st.integers(0, 3), st.integers(0, 70).map(lambda k: k << 100), st.integers(0, (1 << 128) - 1))


@given(st.lists(st.lists(ID, max_size=4).map(tuple), unique=True, min_size=1, max_size=25))
@settings(max_examples=150, deadline=None)
def test_radix_tree_matches_brute_force(keys):
    check_tree(keys)


def test_layouts_grow_and_paths_stay_short():
    for n, kind, size in ((4, conversation_trie.Few, 4), (16, conversation_trie.Few, 16), (48, conversation_trie.Indexed, None), (256, conversation_trie.Full, None)):
        tree = check_tree([(k << 120, 5) for k in range(n)])
        assert type(tree.root.children) is kind and (size is None or tree.root.children.size == size)
        assert all(len(child.path) == 2 * conversation_trie.WIDTH - 1 for _, child in tree.root.children)
