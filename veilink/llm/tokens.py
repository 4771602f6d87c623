"""Encoding a corpus with a public byte-level BPE tokenizer, inside the JVM.

Texts are cut into words by the tokenizer's own pattern. Each word is a byte array that a higher-order ``aggregate``
folds: at every step the adjacent pair of lowest rank is merged. The ranks are a literal map, laid out as a
row-displacement table (one flat array; the pair ``(a, b)`` stands at ``base[a] + b``), so a lookup is one array read
however many merges there are.

Distinct words are encoded once: the ``dictionary_words`` most frequent words of the corpus (a bounded number, counted
over all texts) become a literal dictionary of their ids. A word that isn't in it is folded where it stands, so no
word is ever left out, nothing is shuffled but word counts, and nothing that is sent out grows with the data.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import slots, spread

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# Fixed value: the published pre-tokenisation pattern of the vocabulary, with Unicode classes switched on.
WORD_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = 1 << 30  # no such pair


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, with the byte.

    Printable Latin-1 characters stand for themselves; the other bytes take the code points from 256 on, in order.
    """
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """Ids of single bytes, byte strings of all ids, and the displaced rank table."""

    byte_ids: tuple[int, ...]
    pieces: tuple[bytes, ...]
    base: np.ndarray
    table: np.ndarray  # left id * 65536 + merged id, -1 where free


def displaced(pairs: list[tuple[int, int, int]], n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit row displacement of (left, right) -> merged; long rows are placed first."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for a, b, merged in pairs:
        rows.setdefault(a, []).append((b, merged))
    starts = 2 * len(pairs) + 1  # the row of the most pairs always finds a place among so many
    base, table = np.zeros(n_ids, np.int64), np.full(starts + n_ids, -1, np.int64)
    taken = np.zeros(starts + n_ids, bool)
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        blocked = np.zeros(starts, bool)
        for b, _ in row:
            blocked |= taken[b : b + starts]
        start = int(np.argmin(blocked))
        at = start + np.array([b for b, _ in row])
        base[a], taken[at], table[at] = start, True, [a * 65536 + merged for _, merged in row]
    used = int(np.flatnonzero(table >= 0).max(initial=0))
    return base, table[: max(used + 1, int(base.max()) + n_ids)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file with ``vocab`` and ``merges``; ranks must follow the ids, as they do in public files."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, alphabet = model["vocab"], byte_alphabet()
    pairs, last = [], -1
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        if (merged := ids[a + b]) <= last:
            raise ValueError("the ids of merges must rise with their ranks")
        last = merged
        pairs.append((ids[a], ids[b], merged))
    pieces = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        pieces[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    byte_ids = [0] * 256
    for c, b in alphabet.items():
        byte_ids[b] = ids[c]
    return Vocabulary(tuple(byte_ids), tuple(pieces), *displaced(pairs, len(pieces)))


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def literal_ints(values) -> Column:
    """A literal array: the split string is folded to one array value when the plan is optimised."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def split_words(text: Column) -> Column:
    """Words of a text by the tokenizer's pattern; null and empty texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def fold_word(word: Column, v: Vocabulary) -> Column:
    """Ids of one word by the fold of ranked merges over its byte array."""
    base, table, single = literal_ints(v.base), literal_ints(v.table), literal_ints(v.byte_ids)
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # one character a byte
    n = F.octet_length(word)
    start = F.transform(F.sequence(F.lit(1), n), lambda i: single[F.ascii(F.substring(latin, i, 1))])

    def merged(t: Column) -> Column:
        def pair(i: Column) -> Column:
            hit = table[base[t[i]] + t[i + 1]]
            return F.when(F.shiftright(hit, 16) == t[i], hit.bitwiseAND(65535)).otherwise(F.lit(NONE))

        lowest = F.array_min(F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.struct(pair(i).alias("id"), i.alias("i"))))
        return F.transform(
            F.array(lowest),
            lambda low: F.when(
                low["id"] < NONE,
                F.struct(F.concat(F.slice(t, 1, low["i"]), F.array(low["id"]), F.slice(t, low["i"] + 3, F.size(t))).alias("t"), F.lit(False).alias("done")),
            ).otherwise(F.struct(t.alias("t"), F.lit(True).alias("done"))),
        )[0]

    folded = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(start.alias("t"), F.lit(False).alias("done")),
        lambda acc, _: F.when(acc["done"] | (F.size(acc["t"]) < 2), acc).otherwise(merged(acc["t"])),
        lambda acc: acc["t"],
    )
    return F.when(n > 0, folded).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class Dictionary:
    """Ids of frequent words, by slot of a hash table."""

    slots: int
    as_json: str

    def ids(self, word: Column) -> Column:
        """Ids of a word that is in the dictionary, else null."""
        entries = F.from_json(F.lit(self.as_json), "struct<w:array<string>,i:array<array<bigint>>>")
        slot = F.pmod(F.xxhash64(word), F.lit(self.slots)).cast("int")
        return F.when(entries["w"][slot] == word, entries["i"][slot])


def build_dictionary(texts: DataFrame, column: str, v: Vocabulary, dictionary_words: int = 8192, longest: int = 64) -> Dictionary:
    """Encode the most frequent words of all texts once. Words over ``longest`` characters and those that lose their slot
    to a more frequent word stay outside; they are folded where they occur."""
    n_slots = 1 << max(1, (4 * dictionary_words - 1).bit_length())
    counts = texts.select(F.explode(split_words(F.col(column))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    kept = counts.where(F.length("w") <= longest).withColumn("slot", F.pmod(F.xxhash64("w"), F.lit(n_slots)).cast("int"))
    top = kept.orderBy(F.desc("n"), "w").limit(dictionary_words)
    rows = (
        top.repartition(slots(texts.sparkSession), "w")
        .select("slot", "n", "w", fold_word(F.col("w"), v).alias("i"))
        .collect()  # bounded: dictionary_words words of at most ``longest`` characters
    )
    words, ids = [""] * n_slots, [[]] * n_slots
    for r in sorted(rows, key=lambda r: (r["n"], r["w"])):
        words[r["slot"]], ids[r["slot"]] = r["w"], r["i"]
    return Dictionary(n_slots, json.dumps({"w": words, "i": ids}, separators=(",", ":")))


def encoded_words(text: Column, v: Vocabulary, known: Dictionary) -> Column:
    return F.transform(split_words(text), lambda w: F.coalesce(known.ids(w), fold_word(w, v)))


def encode_corpus(documents: DataFrame, text: str = "text", *, out: str = "ids", tokenizer: str | None = None, dictionary_words: int = 8192) -> DataFrame:
    """``documents`` with the column ``out``: token ids of ``text``, without special tokens.

    Null and empty texts give an empty list. A special token's string inside a text is ordinary text. Repeated rows
    are encoded each; other columns pass through (``out`` replaces a column of that name). No row is
    shuffled, unless the input has fewer than half as many partitions as there are task slots.
    """
    v = vocabulary(tokenizer or vocabulary_path())
    documents = spread(documents)
    known = build_dictionary(documents, text, v, dictionary_words)
    return documents.withColumn(out, F.flatten(encoded_words(F.col(text), v, known)).cast("array<int>"))


def count_tokens(documents: DataFrame, text: str = "text", *, out: str = "n_tokens", tokenizer: str | None = None, dictionary_words: int = 8192) -> DataFrame:
    """``documents`` with the number of tokens of ``text`` (0 for null and empty)."""
    v = vocabulary(tokenizer or vocabulary_path())
    documents = spread(documents)
    known = build_dictionary(documents, text, v, dictionary_words)
    sizes = F.aggregate(encoded_words(F.col(text), v, known), F.lit(0).cast("bigint"), lambda s, w: s + F.size(w))
    return documents.withColumn(out, sizes)


def decode_ids(ids: Column, tokenizer: str | None = None) -> Column:
    """Text of a list of ids: the binary pieces are joined, then read as UTF-8. An empty list gives an empty text."""
    v = vocabulary(tokenizer or vocabulary_path())
    pieces = F.split(F.lit(",".join(p.hex() for p in v.pieces)), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: pieces[i]), "")), "UTF-8")
