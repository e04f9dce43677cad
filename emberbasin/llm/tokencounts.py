"""Token counts of whole texts: batch encoding inside tasks, of which only lengths leave.

Texts are parted at safe boundaries: places where the pre-tokenizer parts any text, whatever stands around, so the
tokens of a text are those of its segments. A segment that a worker has met before isn't encoded again; new ones are encoded together,
in batches of about equal bytes. Long segments are parted further, at letters beside digits or ideographic marks.

Boundaries are known for byte-level BPE files whose pre-tokenizer is the usual pattern, without a normalizer; texts for other
tokenizer files, sentencepiece models included, are encoded whole, in batches of equal bytes as well.

Null and empty texts have no tokens. Special strings in texts are handled as the library does by default. Every row
is counted, repeated ones and those without an id too; columns of ``docs`` come back as they are.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberbasin.llm.common import fresh_names, own_columns

#: Text bytes looked at together, and bytes encoded in one call of the library.
SLICE = 4_000_000
BATCH = 500_000
#: A worker that remembers more segments than this forgets them all; segments of more characters aren't remembered.
CACHE_SEGMENTS = 600_000
REMEMBERED = 64
#: Segments of more characters are parted at further boundaries.
LONG = 2_000

#: White space with the word after it, or white space at the end.
SEGMENT = re.compile(r"\s*\S+|\s+")
#: White space to this module's pattern, but a symbol to the tokenizer's.
ODD = re.compile("[\x1c-\x1f]")
#: A letter beside a digit, or before an ideographic mark: the pattern's runs of letters end there.
WITHIN = re.compile(r"(?<=[A-Za-zぁ-ゖァ-ヺ一-鿿가-힣])(?=[0-9、。，！？；：])|(?<=[0-9])(?=[A-Za-zぁ-ゖァ-ヺ一-鿿가-힣])")


def batches_by_bytes(texts: list[str], size: int) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``size`` bytes, or one text where that is longer."""
    some, held = [], 0
    for text in texts:
        n = len(text.encode("utf-8", "surrogatepass"))
        if some and held + n > size:
            yield some
            some, held = [], 0
        some.append(text)
        held += n
    if some:
        yield some


class Counter(dict):
    """Token counts of segments and texts under one vocabulary file; the dict holds what it has met."""

    def __init__(self, path: str):
        super().__init__()
        self.parted = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        self.parted = known_boundaries(json.loads(tokenizer.to_str()))

    def counted(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        if not self.parted:
            return self.encoded(texts)
        segments = [[t] if ODD.search(t) else SEGMENT.findall(t) for t in texts]
        new = set().union(*segments).difference(self)
        if len(self) + len(new) > CACHE_SEGMENTS:
            self.clear()
            new = set().union(*segments)
        new = sorted(new)
        long = {s: WITHIN.split(s) for s in new if len(s) > LONG and not ODD.search(s)}
        parts = [p for s in new for p in long.get(s, (s,))]
        found, at = self.encoded(parts), 0
        for s in new:
            n = len(long.get(s, (s,)))
            self[s] = sum(found[at : at + n])
            at += n
        get = self.__getitem__
        counts = [sum(map(get, some)) for some in segments]
        for s in new:
            if len(s) > REMEMBERED:
                del self[s]
        return counts

    def encoded(self, texts: list[str]) -> list[int]:
        return [n for some in batches_by_bytes(texts, BATCH) for n in self.lengths(some)]


def known_boundaries(spec: dict) -> bool:
    """Whether :data:`SEGMENT` and :data:`WITHIN` part texts only where this tokenizer does."""
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    whole = lambda t: not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) or WITHIN.search(t["content"]))
    return bool(plain and spec.get("normalizer") is None and all(map(whole, spec.get("added_tokens") or [])))


def counter(path: str) -> Counter:
    """One per worker process, kept between its tasks."""
    held = sys.__dict__.setdefault("_emberbasin_token_counters", {})
    if path not in held:
        held[path] = Counter(path)
    return held[path]


def token_count(text: Column, path: str) -> Column:
    """The number of tokens of each text, as a long; only lengths come back from Python."""

    def lengths(texts: pa.Array) -> pa.Array:
        count, out = counter(path), np.zeros(len(texts), np.int64)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // SLICE
        for start, end in zip(np.flatnonzero(np.diff(group, prepend=-1)), np.flatnonzero(np.diff(group, append=-1)) + 1):
            out[start:end] = count.counted([t or "" for t in texts[start:end].to_pylist()])
        return pa.array(out)

    return F.arrow_udf(lengths, "long")(text)


def with_token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with n_bytes, n_tokens and over_limit; names that docs has already get underscores in front."""
    (n_bytes, n_tokens, over) = fresh_names(docs, "n_bytes", "n_tokens", "over_limit")
    body = F.col(text).cast("string")
    return docs.select(
        *own_columns(docs), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias(n_bytes), token_count(body, path).alias(n_tokens)
    ).withColumn(over, F.col(n_tokens) > limit)
