"""Token counts of whole texts as a byte-pair tokenizer with word ends gives them.

Whole-token shortcut: offline, every vocabulary string that can be a pre-token is encoded
on its own; those that come back as their one token need no merging later. In a text, a
pre-token found in that table counts as one, and only the rest is merged by the
tokenizer's library.

The normalizer and the pre-tokenizer never look across ASCII white space, so a text is the
sum of its space-separated pieces. Pieces seen before are counted from a bounded memo.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship

#: Entries of a Python worker's memos, of pieces and of merged pre-tokens.
MEMO = 500_000
#: Pre-tokens merged in one call.
MERGED = 4096
#: Longer pieces are not remembered.
MEMO_BYTES = 64

WORD_END = "</w>"
#: The pre-token pattern of the vocabulary file.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
    """
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings that, encoded alone, are exactly one token.

    Only strings that the normalizer leaves alone and the pre-tokenizer does not split can
    be met as a pre-token; the others are not tried.
    """
    letters, pattern = byte_letters(), regex.compile(PRE_TOKEN)
    tried = {}
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if not token.endswith(WORD_END):
            continue
        try:
            text = bytes(letters[c] for c in token.removesuffix(WORD_END)).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and pattern.findall(text) == [text] and tokenizer.normalizer.normalize_str(text) == text:
            tried[text] = number
    found = tokenizer.encode_batch(list(tried), add_special_tokens=False)
    return frozenset(text for (text, number), e in zip(tried.items(), found) if e.ids == [number])


class Memo:
    """A bounded table of what was learnt; once full it keeps what is in use just then."""

    def __init__(self, size: int, learn):
        self.size, self.learn, self.known, self.long = size, learn, {}, []

    def of(self, keys: set) -> dict:
        """A table with all of ``keys``, valid until the next call."""
        for key in self.long:
            del self.known[key]
        new = keys - self.known.keys()
        if len(self.known) + len(new) > self.size:
            self.known = {k: self.known[k] for k in keys - new}
        self.known.update(self.learn(list(new)))
        self.long = [k for k in new if len(k) > MEMO_BYTES]
        return self.known


class Counter:
    """Counts tokens of pieces without white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = prove_whole_tokens(self.tokenizer)
        self.pattern = regex.compile(PRE_TOKEN)
        self.pieces, self.tokens = Memo(MEMO, self.learn), Memo(MEMO, self.merge)

    def merge(self, tokens: list[str]) -> dict[str, int]:
        """Tokens that the library makes of each pre-token."""
        out = []
        for i in range(0, len(tokens), MERGED):
            part = tokens[i : i + MERGED]
            # A space parts pre-tokens and is dropped, so the library numbers them 0, 1, ...
            whose = self.tokenizer.encode(" ".join(part), add_special_tokens=False).word_ids
            out += np.bincount(np.array(whose, dtype=np.int64), minlength=len(part)).tolist()
        return dict(zip(tokens, out))

    def normalize(self, pieces: list[bytes]) -> list[str | None]:
        """Normalized pieces; None for one that the library has to see by itself."""
        texts = [piece.decode("utf-8", "replace") for piece in pieces]
        plain = " ".join(texts)
        out = (plain.lower() if plain.isascii() else self.tokenizer.normalizer.normalize_str(plain)).split(" ")
        if len(out) != len(pieces):
            # Some piece holds white space beyond ASCII.
            out = [self.tokenizer.normalizer.normalize_str(text) for text in texts]
            out = [None if " " in text else text for text in out]
        return [None if any(s in piece for s in self.special) else text for piece, text in zip(pieces, out)]

    def learn(self, pieces: list[bytes]) -> dict[bytes, int]:
        """Tokens of each piece."""
        counts, alone, merged, whose = [0] * len(pieces), [], [], []
        for part in range(0, len(pieces), MERGED):
            for i, text in enumerate(self.normalize(pieces[part : part + MERGED]), part):
                if text is None:
                    alone.append(i)
                elif text in self.whole:
                    counts[i] = 1
                else:
                    for token in self.pattern.findall(text):
                        if token in self.whole:
                            counts[i] += 1
                        else:
                            merged.append(token)
                            whose.append(i)
        known = self.tokens.of(set(merged))
        for i, token in zip(whose, merged):
            counts[i] += known[token]
        texts = [pieces[i].decode("utf-8", "replace") for i in alone]
        for i, e in zip(alone, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            counts[i] = len(e.ids)
        return dict(zip(pieces, counts))

    def count(self, texts: list[bytes]) -> list[int]:
        split = [text.split() for text in texts]
        known = self.pieces.of(set().union(*split))
        return [sum(map(known.__getitem__, pieces)) for pieces in split]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def _groups(column: pa.Array, size: int):
    """(first row, texts) of about ``size`` bytes; a longer text stands alone."""
    group, total, first = [], 0, 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        text = value.as_py() or b""
        if group and total + len(text) > size:
            yield first, group
            group, total, first = [], 0, i
        group.append(text)
        total += len(text)
    if group:
        yield first, group


def _count_tokens(path: str, chunk: int):
    def count(batches):
        counter = _counter(path)
        for batch in batches:
            sizes, tokens = [], []
            for _, texts in _groups(batch.column("text"), chunk):
                sizes += map(len, texts)
                tokens += counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return count


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk: int = 1 << 21) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of each text.

    ``path`` names the vocabulary file, which every executor has at that place. Counts are
    the library's, without added special tokens; special strings inside a text are handled
    as it does by default. A null or empty text has 0 bytes and 0 tokens. Every row gives
    one row, repeated ones and null doc_ids too; other columns are ignored. No shuffle.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = docs.mapInArrow(_count_tokens(path, chunk), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
