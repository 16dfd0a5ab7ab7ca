"""Row-wise operators against brute force, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelmill.llm import chat_format, decontaminate, packing, quality_rules, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
KIND = "doc_id long, text string, n_words long, size int"


def docs(spark, texts, start=1):
    return spark.createDataFrame([(i, t, -1, 0) for i, t in enumerate(texts, start)], KIND)


# --- quality rules ---------------------------------------------------------------------------


def repeat_words(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({k for i, g in enumerate(grams) if grams.count(g) > 1 for k in (i, i + 1, i + 2)})


def test_measures_match_brute_force(spark):
    texts = [None, "", " \n ", "a b c a b c", "a a a a a", "x\nx\n\n y \nx", "#a $$ <b>|&%*", "é ü z\x0bq", "a b c d " * 40, "one"]
    rows = quality_rules.ledger(docs(spark, [*texts, texts[3]])).collect()
    for row, text in zip(sorted(rows, key=lambda r: r.doc_id), [*texts, texts[3]], strict=True):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row.n_words, row.word_chars) == (len(words), sum(map(len, words)))
        assert row.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert (row.n_lines, row.n_dup_lines) == (len(lines), len(lines) - len(set(lines)))
        assert row.n_repeat_words == repeat_words(words)


def test_policies_and_ablations_are_bits(spark):
    rows = quality_rules.ledger(docs(spark, ["word " * 60, "one two", " ".join(f"w{i}" for i in range(80)), "vequdé " + " ".join(f"w{i}" for i in range(80))]), ["vequ"])
    kept = {r.doc_id: (r.base, r.v2) for r in rows.select("doc_id", quality_rules.verdict("base").alias("base"), quality_rules.verdict("v2").alias("v2")).collect()}
    assert kept == {1: (False, False), 2: (False, False), 3: (True, True), 4: (True, False)}
    found = {r.rule: (r.failed, r.failed_alone) for r in quality_rules.ablations(rows, "v2").collect()}
    assert found["few_words"] == (1, 1) and found["blocked_stems"] == (1, 1)
    assert quality_rules.ledger(docs(spark, [])).count() == 0


# --- chat formatting -------------------------------------------------------------------------


@given(st.text(alphabet="<|turn>ext\\s/[INS]é\n", max_size=40))
@settings(max_examples=60, deadline=None)
def test_unescape_reads_any_mark(text):
    template = chat_format.Template()
    pattern = "|".join(re.escape(c) for c in template.controls)
    escaped = re.sub(f"(?=(?:{pattern}))(.)", r"\1\\", text.replace("\\", "\\\\"), flags=re.S)
    assert chat_format.unescaped(escaped) == text and not re.search(pattern, escaped)


def test_conversations_read_back(spark):
    turns = [
        (1, 0, "user", "hi <|end|>\n\\<|turn|>"), (1, 1, "assistant", "</s>[INST] ok [/INST]\\"), (1, 2, "user", None), (1, 2, "user", None),
        (2, 5, "assistant", "alone"), (3, 0, None, "x"), (3, 1, "<|turn|>\n", "y"), (None, None, "user", "q"), (None, None, "assistant", ""),
    ]
    rows = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, loss int")
    template = chat_format.Template()
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.segments(rows, template), template).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((t[1:] for t in turns if t[0] == conv), key=lambda t: (t[0] is not None, t[0], t[1] or "", t[2] or ""))
        whole = "".join(f"{r or ''}\n{x or ''}\n" for _, r, x in mine)
        loss = "".join(x or "" for _, r, x in mine if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c].n_faults for c in (1, 2, 3, None)] == [1, 1, 2, 2]
    assert chat_format.segments(rows.limit(0), template).count() == 0


# --- decontamination -------------------------------------------------------------------------


def brute_hits(words, items, window):
    hit, found = set(), set()
    for item, seq in items:
        size = min(window, len(seq))
        grams = {tuple(seq[i : i + size]) for i in range(len(seq) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(item)
    return hit, found


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=6), st.lists(st.sampled_from("abcd"), max_size=40))
@settings(max_examples=150, deadline=None)
def test_automaton_matches_brute_force(items, words):
    automaton = decontaminate.SuffixAutomaton(4)
    for i, item in enumerate(items):
        automaton.insert(i, [w.encode() for w in item])
    spans, found = automaton.finish().matches([w.encode() for w in words])
    hit, ids = brute_hits(words, list(enumerate(items)), 4)
    assert {k for a, b in spans for k in range(a, b + 1)} == hit and found == ids
    assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_windows_that_begin_before_a_short_item():
    automaton = decontaminate.SuffixAutomaton(10)
    automaton.insert(1, [b"delta"])
    automaton.insert(None, b"a b c delta e f g h i j".split())
    spans, found = automaton.finish().matches(b"x a b c delta e f g h i j y".split())
    assert spans == [[1, 10]] and found == {1}


def test_items_without_an_id_and_with_names(spark):
    rows = docs(spark, ["say one two three now", "four five"])
    items = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "four five")], "item_id string, text string")
    for size in (1, 100):
        got = {r.doc_id: (r.items, [tuple(s) for s in r.spans]) for r in decontaminate.contamination(rows, items, block_words=size).collect()}
        assert got == {1: (["a", "b"], [(1, 3)]), 2: ([], [(0, 1)])}


def test_blocks_and_cleaning(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "Lazy DOG!"), (2, "Lazy DOG!"), (3, None), (4, ""), (5, "ü ö ä ß")], "item_id long, text string")
    rows = docs(spark, ["say: the QUICK, brown fox jumps. over a lazy dog, no more words here", None, "", "lazy dog", "ü ö ä ß and many other words in this text"])
    for size in (3, 1000):  # several automata, or one
        got = {r.doc_id: r for r in decontaminate.contamination(rows, items, window=4, block_words=size).collect()}
        assert [got[k].items for k in (1, 2, 3, 4, 5)] == [[1, 2], [], [], [2], [5]] and got[1].n_words == 14
    kept = {r.doc_id: r.text for r in decontaminate.decontaminated(rows, items, window=4).collect()}
    assert kept == {1: "say: . over a , no more words here", 2: None, 3: "", 5: " and many other words in this text"}
    assert decontaminate.contamination(rows, items.limit(0)).filter("size(spans) > 0").count() == 0


# --- tokens and packing ----------------------------------------------------------------------

HARD = [
    None, "", " ", "a", "  two  spaces ", "line\n\n next\t tab \x0b\x0c x", "it's we'll 's ''s", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>",
    "中文 mixed ½ ² text  wide space", "x" * 3000, "word " * 900, "nospace" * 700 + " " + "\n" * 50 + "tail", "é×÷ʰ\x00\x1f ok", "1234 56a b7 " * 300,
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    machine = Tokenizer.from_file(VOCABULARY)
    return lambda text: machine.encode(text or "", add_special_tokens=False).ids


def test_token_counts_across_chunks(spark, reference):
    texts = [*HARD, HARD[5]]
    for size in (7, 64, 16_384):
        got = {r.doc_id: r for r in tokens.token_counts(docs(spark, texts), VOCABULARY, chunk_chars=size).collect()}
        for i, text in enumerate(texts, 1):
            assert (got[i].n_bytes, got[i].n_tokens) == (len((text or "").encode()), len(reference(text))), (size, text)
    assert tokens.token_counts(docs(spark, []), VOCABULARY).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 50), packing.Limits(32, 32, 32)])
def test_packing_is_a_partition_within_limits(spark, reference, limits):
    texts = [*HARD, *HARD]
    rows = packing.packed(docs(spark, texts).repartition(3), VOCABULARY, limits).toPandas()
    for i, text in enumerate(texts, 1):
        ids = np.array([*reference(text), 0], "<u4")
        mine, at = rows[rows.doc_id == i].sort_values("start"), 0
        for r in mine.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        total = int(s.length.sum())
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert total <= limits.tokens and (total == limits.tokens or total & (total - 1) == 0)
        assert len(s) <= limits.segments and s.loss_tokens.sum() <= limits.loss_tokens
    assert packing.packed(docs(spark, []), VOCABULARY).count() == 0
