"""Byte-pair encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side in no token of the vocabulary
can never be merged, so a cut between them is certain. Texts are cut there, the
fragments are encoded one by one, each distinct fragment once for a Python
worker, and their ids are put together again.

The pre-tokenizer's pattern must give the same pieces on both sides of a cut.
It does where the character before the cut is no white space (its look-ahead
reads white space only) and the one after it is no apostrophe (which could
start a contraction); other forced pairs are not cut.

Nulls and empty texts have no ids and decode to the empty text. Extra columns
pass through; an output name that is taken already is replaced. Rows are
independent: repeated rows give repeated results, and an empty table an empty
one.
"""

from __future__ import annotations

import functools
import heapq
import json
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from driftwatch.llm.tokens import UNCOMMON

#: Distinct fragments that a Python worker remembers; the memory is emptied when it is full.
REMEMBERED = 600_000
#: From so many bytes on, a fragment's merges are taken from a heap.
LONG = 200
#: A merge is one number: its rank, then the id that it makes in so many bits.
BITS = 20
MASK = (1 << BITS) - 1
NONE = 1 << 62
#: Stands for the ids of a word that doesn't end at a forced boundary.
OPEN: tuple[int, ...] = ()


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file.

    Printable Latin-1 characters stand for themselves and the other bytes take
    the code points from 256 on, in order.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A vocabulary, its merges and its forced boundaries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        to_bytes = lambda word: bytes(alphabet[c] for c in word)
        vocabulary = {to_bytes(word): i for word, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.words = dict.fromkeys(range(max([*vocabulary.values(), *self.special.values()]) + 1), b"")
        self.words |= {i: word for word, i in vocabulary.items()}
        self.words |= {i: text.encode() for text, i in self.special.items()}
        self.single = [vocabulary[bytes([b])] for b in range(256)]
        self.codes: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = map(to_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            self.codes[vocabulary[left], vocabulary[right]] = rank << BITS | vocabulary[left + right]
        single = self.single
        self.first_codes = {(a, b): self.codes.get((single[a], single[b]), NONE) for a in range(256) for b in range(256)}
        self.inside = {pair for word in vocabulary for pair in zip(word, word[1:], strict=False)}
        self.pieces = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words_seen: dict[str, tuple[int, ...]] = {}
        self.fragments_seen: dict[str, tuple[int, ...]] = {}
        self.pairs_seen: dict[str, bool] = {}
        self.names = [*map(str, self.words)]
        self.ids = [*self.words]  # one object for each id, whatever remembers it
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.alphabet = alphabet

    def forced(self, pair: str) -> bool:
        """Whether a cut between two neighbouring characters is certain."""
        found = self.pairs_seen.get(pair)
        if found is None:
            left, right = pair
            found = (
                not left.isspace()
                and not UNCOMMON.match(left)
                and right != "'"
                and (left.encode()[-1], right.encode()[0]) not in self.inside
            )
            if len(self.pairs_seen) >= REMEMBERED:
                self.pairs_seen.clear()
            self.pairs_seen[pair] = found
        return found

    def fragments(self, text: str) -> list[str]:
        """The text between forced boundaries, in order."""
        known, cuts = self.pairs_seen, [0]
        for i in range(1, len(text)):
            pair = text[i - 1 : i + 1]
            if known[pair] if pair in known else self.forced(pair):
                cuts.append(i)
        if len(cuts) == 1:
            return [text] if text else []
        return [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def split(self, fragment: str) -> list[bytes]:
        """The pre-tokens of a fragment; the library itself splits characters whose class depends on its version."""
        if not UNCOMMON.search(fragment):
            if fragment[fragment[0] == " " :].isalpha():
                return [fragment.encode()]
            return [piece.encode() for piece in self.pieces.findall(fragment)]
        return [bytes(self.alphabet[c] for c in piece) for piece, _ in self.splitter.pre_tokenize_str(fragment)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the merge of lowest rank first, the leftmost of equal ones."""
        ids = [*map(self.single.__getitem__, piece)]
        if len(ids) >= LONG:
            return self._merge_long(ids)
        get = self.codes.get
        codes = [*map(self.first_codes.__getitem__, zip(piece, piece[1:]))]  # noqa: B905
        while codes and (best := min(codes)) != NONE:
            i = codes.index(best)
            ids[i : i + 2] = [best & MASK]
            del codes[i]
            if i:
                codes[i - 1] = get((ids[i - 1], ids[i]), NONE)
            if i < len(codes):
                codes[i] = get((ids[i], ids[i + 1]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of candidate merges over a linked list of ids."""
        n, get = len(ids), self.codes.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            code, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = code & MASK, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def encode_fragment(self, fragment: str) -> tuple[int, ...]:
        """The ids of one fragment, remembered."""
        found = self.fragments_seen.get(fragment)
        if found is None:
            found = tuple(map(self.ids.__getitem__, chain.from_iterable(map(self.merge, self.split(fragment)))))
            if len(self.fragments_seen) >= REMEMBERED:
                self.fragments_seen.clear()
            if len(fragment) < 100:
                self.fragments_seen[fragment] = found
        return found

    def _after_space(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word with a space before it; none for a word after which a space isn't a certain cut."""
        seen = self.words_seen
        if len(seen) >= REMEMBERED:
            seen.clear()
        parts = [*map(seen.get, words)]
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    word = words[i]
                    if word and self.forced(word[-1] + " "):
                        part = tuple(chain.from_iterable(map(self.encode_fragment, self.fragments(" " + word))))
                    parts[i] = seen[word] = part or OPEN
        return parts

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        """The ids of a text without special tokens, in parts. Most forced boundaries are single spaces."""
        first, *words = text.split(" ")
        if first and self.forced(first[-1] + " ") and OPEN not in (parts := self._after_space(words)):
            return [*map(self.encode_fragment, self.fragments(first)), *parts]
        return [*map(self.encode_fragment, self.fragments(text))]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; a special token's string is that token."""
        parts = self.specials.split(text) if self.specials else [text]
        if len(parts) == 1:
            return [*chain.from_iterable(self._plain(text))]
        ids: list[int] = []
        for part in parts:
            ids += [self.special[part]] if part in self.special else chain.from_iterable(self._plain(part))
        return ids

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.words.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def byte_pairs(path: str) -> BytePairs:
    """One vocabulary for a Python worker and path."""
    return BytePairs(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the array column ``ids`` of the token ids of the whole ``text``."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        return pa.array([byte_pairs(path).encode(x or "") for x in texts.to_pylist()], type=pa.list_(pa.int32()))

    return df.withColumn(ids, encoded(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the string column ``text`` that the token ids stand for."""

    @F.arrow_udf(T.StringType())
    def decoded(rows: pa.Array) -> pa.Array:
        return pa.array([byte_pairs(path).decode(x or ()) for x in rows.to_pylist()], type=pa.string())

    return df.withColumn(text, decoded(F.col(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the encoded and again decoded ``text``.

    The ids stay in the task that made them; only their digests leave it.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pa.Array) -> pa.Array:
        pairs, n, encoded, decoded = byte_pairs(path), [], [], []
        for x in texts.to_pylist():
            ids = pairs.encode(x or "")
            n.append(len(ids))
            encoded.append(sha256(",".join(map(pairs.names.__getitem__, ids)).encode()).hexdigest())
            decoded.append(sha256(pairs.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    out = df.withColumn("_digests", digests(F.col(text)))
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return out.withColumns({name: F.col(f"_digests.{name}") for name in names}).drop("_digests")
