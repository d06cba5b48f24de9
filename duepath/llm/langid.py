"""Language identification by compression: the dictionary that shortens a text most names its language.

One zstandard raw-content dictionary per language is cut from a bounded sample: of each learned language the
``SAMPLE_DOCS`` documents with the smallest hash of doc_id, ``SAMPLE_PIECES`` pieces of ``SAMPLE_CHARS`` characters spread
over each of them, ``DICT_BYTES`` in all. Texts are lower-cased, everything but letters becomes one blank, and the whole
text is encoded with every dictionary: its first ``HEAD`` bytes from each of their words on, of which the mean size counts,
since a single frame of so few bytes tells little; what follows in frames of ``PIECE`` bytes.

Defined cases: null text and text without a letter give ``und`` and score 0; equal sizes go to the language with more
learned rows, then by name; without any learned row everything is ``und``; empty tables give no rows; a document
counts as learned row only if text and lang are there; other columns are kept by ``keep_identified`` and ignored by
``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duepath.llm.rows import few_of_each

SAMPLE_DOCS, SAMPLE_PIECES, SAMPLE_CHARS, DICT_BYTES = 250, 4, 100, 32_768
PIECE, HEAD, LEVEL = 1024, 160, 9
#: Below this score (the share of the second-best size that the best dictionary saves) a text is rejected. Nearly all
#: texts of over 256 bytes in a learned language save 0.07 and more, texts in no learned one, mixed ones and junk at most 0.01.
MIN_SCORE = 0.02
UNKNOWN, PART = "und", 512

_LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Classifier:
    """Languages, those with more learned rows first, and their dictionaries. Compressors are made on first use."""

    languages: list[str]
    dictionaries: list[bytes]
    _compressors: list = field(default_factory=list)

    def __getstate__(self):
        return {"languages": self.languages, "dictionaries": self.dictionaries, "_compressors": []}

    def _sizes(self, body: bytes) -> list[float]:
        if not self._compressors:
            for raw in self.dictionaries:
                params = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
                cut = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                cut.precompute_compress(compression_params=params)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=cut, compression_params=params))
        head, rest = body[:HEAD], range(HEAD, len(body), PIECE)
        parts, at = [head], head.find(b" ")
        while at >= 0:
            parts.append(head[at + 1 :])
            at = head.find(b" ", at + 1)
        return [sum(len(c.compress(p)) for p in parts) / len(parts) + sum(len(c.compress(body[k : k + PIECE])) for k in rest) for c in self._compressors]

    def classify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        sizes = self._sizes(letters(text))
        best, *rest = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        # the share of the next best size that is saved, whatever the length
        return self.languages[best], 1.0 - sizes[best] / sizes[rest[0]] if rest else 1.0


def learned(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang of the rows that may be learned from, with a clash-free set of columns."""
    bucket = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    return docs.select("doc_id", "text", "lang").where((bucket != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def train(docs: DataFrame) -> Classifier:
    """Dictionaries from a bounded sample; counts (for ties) from all learned rows."""
    rows = learned(docs)
    sample, counts = few_of_each(rows, "lang", SAMPLE_DOCS)
    spread = F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) / (SAMPLE_PIECES - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PIECES - 1)), lambda i: F.substring(F.col("text"), F.floor(i * spread).cast("int") + 1, F.lit(SAMPLE_CHARS)))
    sample = sample.select("lang", "place", F.array_join(F.array_distinct(pieces), " ").alias("text"))
    buffers: dict[str, bytearray] = {}
    for row in sample.orderBy("lang", "place").collect():
        body = letters(row["text"])
        if body:
            buffers.setdefault(row["lang"], bytearray()).extend(body + b" ")
    languages = sorted(buffers, key=lambda lang: (-counts.get(lang, 0), lang))
    return Classifier(languages, [bytes(buffers[lang][:DICT_BYTES]) for lang in languages])


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, lang_pred, score and ``rejected`` (no letter, or the margin is narrow) for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [model.classify(t.as_py()) for t in batch.column("text")]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([n == UNKNOWN or s < MIN_SCORE for n, s in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Classifier) -> DataFrame:
    """The documents, all columns, whose language is told with a clear margin."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            # in parts, so that a task holds a copy of few texts beside the batch
            for batch in (whole.slice(at, PART) for at in range(0, whole.num_rows, PART)):
                found = [model.classify(t.as_py()) for t in batch.column("text")]
                yield batch.filter(pa.array([n != UNKNOWN and s >= MIN_SCORE for n, s in found], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
