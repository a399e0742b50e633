"""Byte-level BPE encoding and decoding with tree concatenation for long unsplit text.

Ordinary text is encoded in one call. Where a text holds a run without a safe split that is longer
than `leaf` characters, that run is cut into leaves, the leaves are encoded in parallel, and
neighbouring results are concatenated pairwise: a window of tokens around each join is encoded
again and doubled until its first and last tokens agree with both sides, which for byte-pair
merges fixes the whole sequence.

Defined cases: a null text is the empty text and gives no tokens; special-token strings inside a
text become their special ids, as the tokenizers library does by default; invalid UTF-8 from
arbitrary ids decodes with replacement characters.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 8192


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + n)] = b
    return out


class Codec:
    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path}: a byte-level BPE vocabulary without normalizer is needed")
        flags = [t for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        if kind.get("add_prefix_space") or not kind.get("use_regex", True) or flags or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: prefix spaces, other patterns, stripping tokens and ignored merges are not supported")
        symbol = _byte_of_symbol()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = {bytes(symbol[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in self.special}
        order = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][a + b] for a, b in order]
        if ids != sorted(ids):
            raise ValueError(f"{path}: merge ranks and ids differ in order")
        self.core = tiktoken.Encoding("loomgraph", pat_str=PATTERN, mergeable_ranks=raw, special_tokens={})
        self.bytes_of = {i: b for b, i in raw.items()} | {i: s.encode() for s, i in self.special.items()}
        self.leaf = leaf
        self.path = path
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._long = re.compile(r"\S{%d,}|\s{%d,}" % (leaf, leaf))
        self._split = re.compile(r"(?<=\S)(?=[ \t\r\n])")

    # -- encoding -----------------------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        if self._cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in self._cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        if len(text) <= self.leaf or not self._long.search(text):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        held: list[str] = []
        size = 0
        at = 0
        # No pretoken holds a blank after a solid character, so these cuts change nothing.
        for end in [*(m.start() for m in self._split.finditer(text)), len(text)]:
            unit, at = text[at:end], end
            if len(unit) > self.leaf:
                out += self.core.encode_ordinary("".join(held))
                held, size = [], 0
                out += self._unsplit(unit)
            else:
                held.append(unit)
                size += len(unit)
                if size > self.leaf:
                    out += self.core.encode_ordinary("".join(held))
                    held, size = [], 0
        return out + self.core.encode_ordinary("".join(held))

    def _unsplit(self, text: str) -> list[int]:
        """Text of one solid run: cut by the pretokenizer alone, then merged piece by piece."""
        out: list[int] = []
        for _, (a, b) in _pretokenizer(self.path).pre_tokenize_str(text):
            out += self.encode_piece(text[a:b].encode())
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Byte-pair merge of one pretoken, by tree concatenation where it is long."""
        if len(piece) <= self.leaf:
            return self._merge(piece)
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        with ThreadPoolExecutor(2) as pool:  # the merge runs outside the interpreter's lock
            level = list(pool.map(self._merge, leaves))
            while len(level) > 1:
                pairs = [(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
                level = list(pool.map(lambda p: self.concatenate(*p), pairs)) + level[len(pairs) * 2 :]
        return level[0]

    def _merge(self, piece: bytes) -> list[int]:
        return list(self.core._core_bpe.encode_single_piece(piece)) if piece else []

    def _fits(self, a: int, b: int) -> bool:
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def concatenate(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both texts together, from the encodings of each."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self._merge(b"".join(self.bytes_of[i] for i in a + b))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if (whole_left or (window[0] == a[0] and self._fits(left[-k - 1], window[0]))) and (
                whole_right or (window[-1] == b[-1] and self._fits(window[-1], right[k]))
            ):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    # -- decoding -----------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    return Codec(path, leaf)


@lru_cache(4)
def _pretokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids", leaf: int = LEAF) -> DataFrame:
    """`docs` with an array column `to` of token ids of `text`; all other columns stay.

    Runs in one pass without a shuffle; a text is held by one task, in memory of its own size."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + f", `{to}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(kept.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*kept, to])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """`tokens` with a string column `to` decoded from the id array; null arrays give empty text."""
    small_batches(tokens.sparkSession)
    kept = [c for c in tokens.columns if c != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*kept).schema) + f", `{to}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(v or []) for v in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*kept, to])

    return tokens.select(*kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256, decoded_sha256, in one pass over the text: encoding,
    decoding and both digests, so ids never leave the worker."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, leaf)
        sha = hashlib.sha256
        for batch in batches:
            counts, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t or "")
                counts.append(len(ids))
                a.append(sha(repr(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                b.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_path())


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document as doc_id, source, lang, its token ids and their
    number; encoding is checked by decoding on the way (an error stops the job)."""
    path = default_path()
    out = encode(docs.select("doc_id", "source", "lang", "text"), path)
    return out.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"))
