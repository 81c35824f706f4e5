"""Language identification by compression with per-language zstandard raw-content dictionaries.

A language's dictionary is a bounded sample of its training texts. A text is encoded, whole and in
blocks, once with each dictionary; the smallest total wins. The margin to the second is the score,
and below ``MIN_MARGIN`` the prediction is marked as rejected.

The sample: about ``SAMPLE_DOCS`` documents a language, chosen by a 64-bit hash of their key (so a language
of any size gets its share), of each at most ``SAMPLE_CHARS`` characters, cut to ``DICTIONARY_BYTES`` a
language. Only the fit is sampled.

Edge cases: null text, or text without a letter (digits, numerals such as ``½`` or ``Ⅷ`` and marks are none),
is ``und`` with score 0; equal sizes go to the language first in order of its name; no training rows make
every prediction ``und``; a very long text is read whole, in blocks; repeated rows give repeated
predictions; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import built

SAMPLE_DOCS = 120
SAMPLE_CHARS = 4000
DICTIONARY_BYTES = 100_000
LEVEL = 3
BLOCK = 16_384
#: The least share of the best size by which the second must exceed it.
MIN_MARGIN = 0.01
_WORD_CHARACTER = re.compile(r"[^\W\d_]")  # letters, and numerals that aren't digits
_OTHER = re.compile(r"[\W\d_]+")


def _letters(t: str) -> bytes:
    """What is encoded: lower-case letters, with one blank for each run of other characters."""
    return _OTHER.sub(" ", t.lower()).encode()


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Language to dictionary content."""
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(11)).alias("h")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    # the hashes below this share of their range: in whole numbers, as a share may be smaller than a double's steps
    top = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min((1 << 64) - 1, (sample_docs << 64) // n) - (1 << 63))])
    some = rows.filter(F.col("h") <= top[F.col("lang")]).select("lang", "h", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    held: dict[str, bytes] = {}
    for k, _, t in sorted(some.collect()):
        held[k] = held.get(k, b"") + _letters(t) + b" "
    return {k: v[:DICTIONARY_BYTES].ljust(8) for k, v in held.items()}


def has_letter(t: str) -> bool:
    return any(m[0].isalpha() for m in _WORD_CHARACTER.finditer(t))


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.coders = []
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, t: str) -> list[int]:
        data = _letters(t)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, t: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not t or not self.langs or not has_letter(t):
            return "und", 0.0, True
        sizes = self.sizes(t)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
        return self.langs[order[0]], min(1.0, margin), margin < MIN_MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, lang_pred, score, rejected. The dictionaries are bounded by DICTIONARY_BYTES a language, so they are broadcast."""
    token = str(uuid.uuid4())
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = built(token, lambda: Model(held.value))
        for b in batches:
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["key", "lang_pred", "score", "rejected"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
