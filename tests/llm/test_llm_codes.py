"""Vector codes, collocations and packed conversations."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from engagement.llm import collocations, prefix_tree
from engagement.llm.collocations import blocks, frequent_phrases, mine_collocations
from engagement.llm.prefix_tree import Template, Vocabulary, escape, pack_conversations, read_back, unescape
from engagement.llm.vector_codes import choose_pivots, compress_vectors, nearest, squared

VOCABULARY = Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.mark.parametrize("spread", [2, 40, 100_000])
def test_nearest_by_pivots_is_the_nearest(spread):
    numbers = np.random.default_rng(spread)
    vectors, entries = (numbers.integers(-spread, spread, (n, 4)) for n in (3000, 64))
    entries[5], entries[40] = entries[60], entries[9]  # equal entries: the lower index
    pivots = choose_pivots(entries, 4)
    seen = np.sqrt(squared(vectors[:, None, :], pivots[None, :, :])).astype(np.float32)
    index, far = nearest(vectors, seen, entries, pivots)
    every = squared(vectors[:, None, :], entries[None, :, :])
    assert (index == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


VECTORS = "vec_id long, embedding array<double>, label string, code string, best int"


def plain_codes(rows, parts, entries, rounds):
    kept = sorted((i, [int(np.floor(256 * x)) for x in v]) for i, v in rows)
    width = len(kept[0][1]) // parts
    cut = [[v[j * width : (j + 1) * width] for j in range(parts)] for _, v in kept]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        best = [[min((far(c[j], e), i) for i, e in enumerate(books[j])) for j in range(parts)] for c in cut]
        for j in range(parts if n < rounds else 0):
            for e in range(len(books[j])):
                own = [c[j] for c, b in zip(cut, best) if b[j][1] == e]
                if own:
                    books[j][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = [("".join(f"{i:02x}" for _, i in b), sum(d for d, _ in b)) for b in best]
    return {kept[n][0]: code for n, code in enumerate(codes)}, [x for b in books for e in b for x in e]


def test_codes_against_plain_rounds(spark):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-1.0, 0.0, 0.5, draw.gauss(0, 1)]) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(50)]
    odd = [(400, None), (401, []), (402, [0.0, None] * 4), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (405, [1.0] * 7), (406, [1.0] * 12)]
    data = [(i, v, "x" if i % 3 else None, "c", 1) for i, v in rows + odd]
    found = compress_vectors(spark.createDataFrame(data, VECTORS).repartition(5), parts=4, entries=16, rounds=2)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in found.codes.collect()}
    codes, flat = plain_codes(rows, 4, 16, 2)
    assert got == codes and found.flat() == ",".join(map(str, flat))
    assert found.codes.columns == ["vec_id", "label", "code", "error"]


def test_codes_of_odd_tables(spark):
    assert compress_vectors(spark.createDataFrame([], VECTORS)).codes.count() == 0
    assert compress_vectors(spark.createDataFrame([(1, None, None, "", 0)], VECTORS)).codes.count() == 0
    huge = [(1, [1e300] * 16, None, "", 0), (1, [-1e300] * 16, None, "", 0), (None, [0.0] * 16, "a", "", 0), (1, [1e300] * 16, None, "", 0)]
    found = compress_vectors(spark.createDataFrame(huge, VECTORS), entries=2)
    rows = sorted(((r["vec_id"] or 0, r["code"], r["error"]) for r in found.codes.collect()), key=str)
    assert [r[0] for r in rows] == [0, 1, 1, 1] and len({r[1] for r in rows}) == 2
    assert all(r[2] >= 0 for r in rows)


def plain_counts(docs):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang or "und"][" ".join(words[i : i + k])] += 1
    return counts, totals


def plain_collocations(docs, least, top):
    counts, totals = plain_counts(docs)
    out = []
    for lang, own in counts.items():
        scored = {}
        for phrase, a in own.items():
            words = phrase.split(" ")
            if a >= least and len(words) > 1:
                cuts = [(" ".join(words[:k]), " ".join(words[k:])) for k in range(1, len(words))]
                scored[phrase] = min((2000000 * a // (own[x] + own[y]), k, own[x], own[y]) for k, (x, y) in enumerate(cuts))
        kept = []
        for phrase, (score, _, l, r) in scored.items():
            longer = [p for p in scored if len(p.split(" ")) > len(phrase.split(" ")) and f" {phrase} " in f" {p} "]
            if not any(100 * own[p] >= 80 * own[phrase] for p in longer):
                kept.append((-score, -own[phrase], phrase.encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


DOCS = "doc_id long, lang string, text string, phrase string, rank int"


def corpus(seed, n=400):
    draw = random.Random(seed)
    words = ["a", "b", "c", "of", "the", "Ünd", "über", "x", "~", "New", "york"]
    docs = []
    for i in range(n):
        text = " ".join(draw.choices(words, k=draw.randrange(40)))
        if i % 3 == 0:
            text += draw.choice([" ", "\t", ". ", "\n"]) + "New York city hall" + draw.choice(["", "!", " a"])
        if i % 7 == 0:
            text = text.replace(" ", draw.choice([", ", "  ", "\t\t", "\x0b"]), 5) + " once upon a time there was"
        docs.append((draw.choice(["en", "de", None, "und"]), text))
    return docs


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_collocations_against_plain_counts(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "BUCKET", 4000)
    docs = corpus(3)
    rows = spark.createDataFrame([(i, lang, text, "p", 7) for i, (lang, text) in enumerate(docs)], DOCS).repartition(3)
    found = mine_collocations(rows, least=8, top=25)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(docs, 8, 25)
    assert any(len(r["phrase"].split()) == 4 for r in found.collect())


def test_frequent_phrases_are_all_of_them(spark):
    docs = corpus(5)
    rows = spark.createDataFrame([(i, lang, text, "p", 7) for i, (lang, text) in enumerate(docs)], DOCS)
    found = {(r["lang"], r["phrase"]): r["a"] for r in frequent_phrases(rows, least=5).where("words > 0").collect()}
    counts, _ = plain_counts(docs)
    assert found == {(lang, p): a for lang, own in counts.items() for p, a in own.items() if a >= 5}


def test_collocations_of_odd_tables(spark):
    assert mine_collocations(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, None, None, "", 0), (1, "en", "", "", 0), (1, "en", " \t\n.", "", 0)]
    assert mine_collocations(spark.createDataFrame(rows, DOCS)).count() == 0
    # One long text without a break, a word of 3 MB, and a third of all rows the same.
    rows = [(1, "en", "left right " * 200_000, "", 0), (2, "en", "w" * 3_000_000, "", 0)] + [(3, "en", "same same line", "", 0)] * 40
    found = {r["phrase"]: r for r in mine_collocations(spark.createDataFrame(rows, DOCS)).collect()}
    assert found["left right left right"]["a"] == 199_999 and found["same same line"]["a"] == 40
    assert "left right" not in found and found["same same line"]["n"] == 400_000 + 1 + 120


def test_blocks_keep_pieces_whole(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 10)
    texts = [b"aaaa bbbb cccc. dd", b"", b"e f, g" * 9]
    whole = b"".join(blocks(texts))
    assert re.split(rb"[.,\n]\s*", whole) != [] and whole.replace(b"\n", b"") == b"".join(texts).replace(b"\n", b"")
    assert b"aaaa bbbb cccc" in next(iter(blocks(texts)))


@pytest.mark.parametrize(
    "text",
    ["", "plain", "</s>[INST] ok [/INST]", "<<SYS>> x <</SYS>>", "<|im_start|>user<|im_sep|>", "<\\s>", "<\\\\\\/s>", "a<<s>[[INST]", "[\\INST] \\ <| |>", "<<\\SYS>><|endoftext|>"],
)
def test_escape_is_reversible(text):
    done = escape(text)
    assert unescape(done) == text and unescape(escape(done)) == done
    assert not re.search(rf"[<\[](?:{prefix_tree.REST})", done)


@pytest.mark.parametrize("text", ["", "a  b", "x" + " " * 900_000 + "y", "\n" * 700_000, " \t" * 300 + " é", "z" * 800_000, "\u2003" * 600 + "1"])
def test_tokens_are_the_librarys_and_lossless(text):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    template = Template(VOCABULARY)
    found = template.tokens(text)
    assert found == library.encode(text, add_special_tokens=False).ids
    assert template.text(np.array(found, dtype=template.kind)) == text


CHATS = "conv_id long, turn long, role string, text string, tree string, node int"


def plain_digests(rows):
    out, chats = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in chats.items():
        turns = sorted(turns)
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        chars = sum(32 + len(escape(r)) + len(escape(t)) for *_, r, t in turns)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), digest(said), len(learned), digest(learned), chars)
    return out


def chats(seed=2, n=120):
    draw = random.Random(seed)
    texts = ["hi", "é 漢字 🙂", "</s>[INST] ok [/INST]", "a\nb", "", "tell me <|im_end|> more " * 30, None]
    rows = []
    for conv in range(n):
        first = draw.choice(["system", "user"])
        for turn in range(draw.randrange(1, 9)):
            role = first if turn == 0 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn, role, texts[0] if turn == 0 and conv % 3 else draw.choice(texts[: 2 + turn])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], CHATS)


def test_conversations_read_back(spark):
    rows = chats() + [(500, 0, None, "x"), (500, 0, None, "x"), (500, None, "tool", None), (None, 3, "user", "y"), (501, 7, "", "long " * 300_000)]
    found = read_back(pack_conversations(table(spark, rows).repartition(6), VOCABULARY), VOCABULARY)
    assert {r["conv_id"]: tuple(r)[1:] for r in found.collect()} == plain_digests(rows)
    empty = pack_conversations(table(spark, []), VOCABULARY)
    assert empty.nodes.count() == empty.turns.count() == read_back(empty, VOCABULARY).count() == 0


def test_trees_hold_each_turn_once_and_see_their_path(spark):
    rows = chats(4, 200)
    packed = pack_conversations(table(spark, rows).repartition(7), VOCABULARY)
    nodes = {(r["tree"], r["offset"]): r for r in packed.nodes.collect()}
    paths = collections.defaultdict(dict)
    for r in packed.turns.collect():
        paths[r["conv_id"]][r["place"]] = (r["tree"], r["offset"])
    said = collections.defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: r[:2]):
        said[conv].append((role, text or ""))
    beginnings = {tuple(t[: i + 1]) for t in said.values() for i in range(len(t))}
    assert len(nodes) == len(beginnings)
    for tree in {t for t, _ in nodes}:
        # The tokens of a tree lie one after the other, without gaps.
        at = 0
        for (_, offset), r in sorted((k, r) for k, r in nodes.items() if k[0] == tree):
            assert offset == at and r["n_tokens"] * 2 == len(r["tokens"])
            at += r["n_tokens"]
    forks = 0
    for path in paths.values():
        seen, position = set(), 0
        for place in range(len(path)):
            tree, offset = path[place]
            node = nodes[tree, offset]
            assert node["depth"] == place and node["position"] == position and tree == path[0][0]
            position += node["n_tokens"]
            seen |= set(range(offset, offset + node["n_tokens"]))
            spans = [tuple(x) for x in node["attend"]]
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # joined where adjacent
            assert {i for a, b in spans for i in range(a, b)} == seen
            forks = max(forks, len(spans))
    assert forks > 1
