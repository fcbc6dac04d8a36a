"""Token counts, pieces, quality rules and the classifier against plain versions."""

import collections
import math
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from engagement.llm import quality_rules, sentence_pieces
from engagement.llm.quality_rules import estimate_accuracies, judge_quality
from engagement.llm.rule_classifier import RuleModel, keep_quality, rules_of, score_quality
from engagement.llm.sentence_pieces import _pieces, decode_pieces, encode_pieces, units_of
from engagement.llm.token_counts import Counter, Memo, count_tokens

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", "   ", "<|startoftext|>a b<|endoftext|>", "I'll don't 'RE it's", "İstanbul ΑΣ Σ", "x \x85y \x1cz  q",
    "a\x00b", "😀😀 中文 é é", "ﬁ ① 12345", " a  b ", "▁a ▁ ▁▁", "<s> </s> <0x41>", "x" * 5000, "ab " * 5000, "\n\t",
]


def mixed(seed, n):
    r = random.Random(seed)
    letters = "ab'sSřé́中１Ω😀▁<|>. \n\t  "
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(n)]


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 5) for i, t in zip(ids, texts)], "doc_id long, text string, source string, n_pieces int")


def test_token_counts_are_the_library_s(spark):
    texts = ODD + mixed(1, 400)
    library = Tokenizer.from_file(WORDS)
    found = {x["doc_id"]: x for x in count_tokens(table(spark, texts), WORDS, limit=10, chunk=50).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((text or "").encode()), n, n > 10)
    twice = count_tokens(table(spark, ["a b", "a b", None], [1, 1, None]), WORDS).collect()
    assert sorted(str(x["doc_id"]) + str(x["n_tokens"]) for x in twice) == ["12", "12", "None0"]
    assert count_tokens(table(spark, []), WORDS).count() == 0


def test_whole_tokens_are_proven():
    counter = Counter(WORDS)
    assert len(counter.whole) > 20_000 and "the" in counter.whole
    some = sorted(counter.whole)[::997]
    assert all(len(e.ids) == 1 for e in counter.tokenizer.encode_batch(some, add_special_tokens=False))
    memo = Memo(3, lambda keys: {k: len(k) for k in keys})
    assert memo.of({"a", "bb"})["bb"] == 2 and memo.of({"ccc", "d"})["ccc"] == 3 and len(memo.known) <= 4


def test_pieces_are_lossless_and_reproducible(spark):
    texts = ODD + mixed(2, 400)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = encode_pieces(table(spark, texts), PIECES)
    assert rows.columns == ["doc_id", "text", "source", "n_pieces", "pieces", "lossless"]
    found = {x["doc_id"]: x for x in decode_pieces(rows, PIECES).collect()}
    for i, text in enumerate(texts):
        pieces = found[i]["pieces"]
        assert found[i]["lossless"] and found[i]["decoded"] == text and found[i]["n_pieces"] == len(pieces or [])
        if text is not None:
            assert library.decode(pieces) == text
    again = encode_pieces(table(spark, texts).repartition(3), PIECES).collect()
    assert {x["doc_id"]: x["pieces"] for x in again} == {i: x["pieces"] for i, x in found.items()}
    other = encode_pieces(table(spark, texts), PIECES, seed=1).collect()
    assert {x["doc_id"]: x["pieces"] for x in other} != {i: x["pieces"] for i, x in found.items()}
    assert encode_pieces(table(spark, []), PIECES).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([None, -5, 10**6, 1],)], "pieces array<int>")
    assert [x["decoded"] for x in decode_pieces(odd, PIECES).collect()] == [None, "", ""]


@pytest.mark.parametrize("windows", [(1024, 2048, 1 << 16), (8, 4, 64), (8, 1, 7), (8, 10**9, 1 << 16)])
def test_long_units_give_the_same_pieces_in_parts(monkeypatch, windows):
    pieces, draw = _pieces(PIECES, 1.0), random.Random(4)
    kinds = ["a", "ab", "aé", "0123456789abcdef", "語漢字テスト", "ACGT", "thequickbrownfox", "=-_", "😀x"]
    units = ["▁" + "".join(draw.choice(k) for _ in range(3000)) for k in kinds] + ["▁thing", "▁" * 2000 + "x"]
    keys = np.arange(1, len(units) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ids, counts = pieces.sample(units, keys, np.zeros(len(units), dtype=np.int64))
    for name, value in zip(("LONG", "WALKED", "WINDOW"), windows):
        monkeypatch.setattr(sentence_pieces, name, value)
    again, per_unit = sentence_pieces._sample(pieces, units, keys)
    assert counts.tolist() == per_unit.tolist() and ids.tolist() == again.tolist()


@pytest.mark.parametrize("text", ["語漢字テ" * 500_000, "a" * 2_000_000, "0f3a9c" * 400_000, "\u2581" * 100_000, " " * 1_000_000 + "x"])
def test_texts_without_a_space(text):
    pieces = _pieces(PIECES, 1.0)
    units = units_of(text)
    began = time.monotonic()
    ids, counts = sentence_pieces._sample(pieces, units, np.arange(1, len(units) + 1, dtype=np.uint64))
    assert sentence_pieces.decode_flat(pieces, ids, np.array([0, len(ids)])) == [text.encode()]
    assert time.monotonic() - began < 100


def test_segmentations_have_their_probability(spark):
    weights = _pieces(PIECES, 1.0).weights
    unit = units_of("thing")[0]

    def ways(rest):
        if not rest:
            yield (), 1.0
        for end in range(1, len(rest) + 1):
            if rest[:end] in weights:
                number, weight = weights[rest[:end]]
                for more, chance in ways(rest[end:]):
                    yield (number, *more), chance * weight

    expected = dict(ways(unit))
    total, n = sum(expected.values()), 20_000
    drawn = collections.Counter(tuple(x["pieces"]) for x in encode_pieces(table(spark, ["thing"] * n), PIECES).collect())
    assert set(drawn) <= set(expected)
    for way, weight in expected.items():
        assert abs(drawn[way] / n - weight / total) < 0.015


def counts_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark):
    r = random.Random(4)
    texts = ODD + mixed(5, 100) + [" ".join(r.choices("abc", k=60)) + "\n" + "a b\n" * r.randint(0, 4) for _ in range(40)]
    found = {x["doc_id"]: x for x in judge_quality(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        expected = counts_of(text)
        assert tuple(found[i][c] for c in quality_rules.BASE) == expected
        failed = expected[0] < 20 or 100 * expected[4] > 30 * expected[0]
        assert found[i]["base_failed"] == failed and not (failed and found[i]["kept"])
    assert judge_quality(table(spark, [])).count() == 0


def test_estimated_accuracies():
    r = random.Random(6)
    right = [0.95, 0.9, 0.8]
    votes = collections.Counter()
    for _ in range(20_000):
        good = r.random() < 0.8
        vote = tuple(0 if r.random() < 0.2 else (1 if (r.random() < p) == good else -1) for p in right)
        votes[vote] += 1
    prior, odds = estimate_accuracies(sorted(votes.items()), 3, trust=0.001)
    assert prior == pytest.approx(1.386, abs=0.35)
    for p, by_vote in zip(right, odds):
        assert by_vote[1] > 0 > by_vote[-1] and by_vote[1] == pytest.approx(math.log(p / (1 - p)), abs=0.6)


def test_quality_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = score_quality(docs, labels).join(labels, "doc_id")
    rows = scored.where("held_out").collect()
    assert sum(x["predicted"] == x["quality"] for x in rows) >= 0.95 * len(rows)
    judged = judge_quality(docs).drop("quality").join(labels, "doc_id").where("not base_failed").collect()
    assert sum(x["kept"] == (x["quality"] == 1) for x in judged) >= 0.95 * len(judged)


def test_classifier_odd_rows(spark):
    texts = ["a good text of words", None, "", "### %%% $$$", "a good text of words"]
    docs = table(spark, texts, [1, 2, None, 4, 1])
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (77, 1), (2, None)], "doc_id long, quality int")
    found = score_quality(docs, labels).collect()
    assert len(found) == 5 and all(0 <= x["score"] <= 1 and x["predicted"] in (0, 1) for x in found)
    assert {x["held_out"] for x in found if x["doc_id"] is None} == {False}
    assert len({x["score"] for x in found if x["doc_id"] == 1}) == 1
    none = score_quality(docs, labels.limit(0)).collect()
    assert {x["score"] for x in none} == {0.5}
    assert keep_quality(docs, labels.limit(0), threshold=0.4).select(*docs.columns).count() == 5
    assert score_quality(docs.limit(0), labels).count() == 0


def test_rules_from_a_printed_forest():
    text = "\n".join(
        ["  Tree 0 (weight 1.0):", "    If (feature 0 <= 2.5)", "     If (feature 2 <= 0.1)", "      Predict: 0.0",
         "     Else (feature 2 > 0.1)", "      Predict: 1.0", "    Else (feature 0 > 2.5)", "     Predict: 1.0"]
    )
    rules = [r.bounds for r in rules_of(text, ("x", "y", "z"))]
    low = ("x", True, 2.5)
    assert rules == [(low,), (low, ("z", True, 0.1)), (low, ("z", False, 0.1)), (("x", False, 2.5),)]
    assert RuleModel(0.0, []).score() is not None


def test_lattices_are_kept_and_change_nothing(monkeypatch):
    words = ["▁" + w for w in " ".join(t.replace("▁", "") for t in mixed(5, 400)).split()]
    keys = np.arange(len(words), dtype=np.uint64)
    offsets = np.zeros(len(words), dtype=np.int64)
    pieces = sentence_pieces.Pieces(PIECES, 1.0)
    first = pieces.sample(words, keys, offsets)
    built = []
    monkeypatch.setattr(pieces, "edges", lambda *args: built.append(args))
    again = pieces.sample(words, keys, offsets)
    assert not built and all((a == b).all() for a, b in zip(first, again))
    monkeypatch.undo()
    # Bounded, and the same where only a part of the lattices can be kept.
    monkeypatch.setattr(sentence_pieces, "KNOWN", 200)
    bounded = sentence_pieces.Pieces(PIECES, 1.0)
    for a in range(0, len(words), 100):
        part = slice(a, a + 100)
        ids, counts = bounded.sample(words[part], keys[part], offsets[part])
        own, own_counts = pieces.sample(words[part], keys[part], offsets[part])
        assert (ids == own).all() and (counts == own_counts).all()
    assert bounded.kept <= 200
