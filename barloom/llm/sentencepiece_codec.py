"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi.

The automaton over all pieces reads a text once. At each position it reports the
pieces that end there, following output links, and each one relaxes the best
score of that position: best[end] = max(best[start] + score). Characters that
are in no piece are written as byte pieces; every character of a longer piece is
a piece of its own (checked when the model is built).

Pieces hold the space mark at their front only (checked when the model is
built), so no piece crosses the front of a marked word and the best path of a
text is the best paths of its marked words one after another. Words repeat, so
their paths are kept per task up to a bound.

Encoding is reversible: decode(encode(text)) == text for every text. A space
mark in the text itself is written as bytes; the reference library would turn it
into a space.

Defined cases: a null text has no ids (empty array) and decodes to the empty
text. Ties between paths go to the first one found: the longer last piece. Repeated rows are encoded
each. Columns of the input pass through under any name but the new one.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import SLICE_ROWS

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose paths a task keeps, and the length up to which it keeps them.
KEPT_WORDS, KEPT_CHARS = 300_000, 40
CHUNK = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
NEVER = float("-inf")


class Vocabulary:
    """Pieces, scores and kinds of a model; small and fixed in size, so it may travel to every task."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], normal: list[bool]):
        self.pieces, self.scores, self.byte_ids, self.normal = pieces, scores, byte_ids, normal

    @classmethod
    def load(cls, model_file: str = DEFAULT_MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        pieces = [sp.id_to_piece(i) for i in ids]
        byte_ids = {int(pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        normal = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids]
        return cls(pieces, [sp.get_score(i) for i in ids], byte_ids, normal)


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        if len(v.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(v.pieces):
            if v.normal[i] and piece:
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece holds the space mark behind its front")
                self.automaton.add_word(piece, (len(piece), v.scores[i], i))
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in v.pieces]
        self.single = {p for i, p in enumerate(v.pieces) if v.normal[i] and len(p) == 1}
        if any(v.normal[i] and not self.single.issuperset(p) for i, p in enumerate(v.pieces)):
            raise ValueError("a piece holds a character that is no piece of its own")
        # Ids of a word as int32 bytes. Two generations: when the young one is full it becomes the old one, so frequent words stay.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def viterbi(self, chunk: str) -> list[int]:
        """Best path of a chunk in one pass of the automaton."""
        if not self.single.issuperset(chunk):
            return self._with_bytes(chunk)
        n = len(chunk)
        best = [NEVER] * (n + 1)
        best[0] = 0.0
        back = [0] * (n + 1)
        for last, (length, score, i) in self.automaton.iter(chunk):
            last += 1
            total = best[last - length] + score
            if total > best[last]:
                best[last] = total
                back[last] = i
        ids: list[int] = []
        lengths = self.lengths
        while n:
            ids.append(back[n])
            n -= lengths[back[n]]
        ids.reverse()
        return ids

    def _with_bytes(self, chunk: str) -> list[int]:
        """A chunk that holds characters without a piece: these cut it, as no piece crosses them."""
        ids: list[int] = []
        run: list[str] = []
        for c in chunk:
            if c in self.single:
                run.append(c)
                continue
            ids += self.viterbi("".join(run)) if run else []
            run.clear()
            ids += [self.v.byte_ids[b] for b in c.encode()]
        return ids + (self.viterbi("".join(run)) if run else [])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as int32 bytes."""
        if not text:
            return b""
        if MARK in text:
            # Marks of the text itself become bytes, what lies between is encoded on its own.
            mark = np.array([self.v.byte_ids[b] for b in MARK.encode()], np.int32).tobytes()
            first, *rest = text.split(MARK)
            parts = [self._marked(MARK + first.replace(" ", MARK))]
            for part in rest:
                parts += [mark, self._marked(part.replace(" ", MARK))]
            return b"".join(parts)
        return self._marked(MARK + text.replace(" ", MARK))

    def _marked(self, text: str) -> bytes:
        out: list[bytes] = []
        for chunk in CHUNK.findall(text):
            found = self.young.get(chunk)
            if found is None:
                found = self.old.get(chunk)
                if found is None:
                    found = np.array(self.viterbi(chunk), np.int32).tobytes()
                if len(chunk) <= KEPT_CHARS:
                    if len(self.young) >= KEPT_WORDS:
                        self.old, self.young = self.young, {}
                    self.young[chunk] = found
            out.append(found)
        return b"".join(out)


class Decoder:
    """Bytes of every id; control ids say nothing."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.out = np.array([p.replace(MARK, " ").encode() if ok else b"" for p, ok in zip(v.pieces, v.normal)], object)
        for b, i in v.byte_ids.items():
            self.out[i] = bytes([b])

    def __call__(self, ids) -> str:
        """Text of ids; the space that encoding puts in front is taken off."""
        if ids is None or not len(ids):
            return ""
        text = b"".join(self.out[np.asarray(ids)].tolist()).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _held(spark: SparkSession, vocabulary: Vocabulary, kind):
    """A getter that makes one object of the kind per task."""
    shared = spark.sparkContext.broadcast(vocabulary)
    held: list = []

    def get():
        if not held:
            held.append(kind(shared.value))
        return held[0]

    return get


def _mapped(df: DataFrame, source: str, name: str, kind: T.DataType, fn) -> DataFrame:
    """df with one more column; fn makes its Arrow array from that of the source column, a slice of rows at a time."""
    if name in df.columns:
        raise ValueError("a new column has the name of one that exists")
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    at = df.columns.index(source)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, fn(part.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the piece ids of every whole text."""
    get = _held(docs.sparkSession, vocabulary, Codec)

    def fn(texts: pa.Array) -> pa.Array:
        rows = [get().encode_bytes(t) for t in texts.to_pylist()]
        ends = np.cumsum([0] + [len(r) // 4 for r in rows])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return _mapped(docs, text, ids, T.ArrayType(T.IntegerType()), fn)


def decoded(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of every list of ids."""
    get = _held(df.sparkSession, vocabulary, Decoder)

    def fn(rows: pa.Array) -> pa.Array:
        flat, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
        return pa.array([get()(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.string())

    return _mapped(df, ids, text, T.StringType(), fn)


def checked(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs with ids, and whether decoding them gives the text again."""
    both = decoded(encoded(docs, vocabulary, text, "ids"), vocabulary, "ids", "decoded_")
    return both.withColumn("round_trip", F.col("decoded_") == F.coalesce(F.col(text), F.lit(""))).drop("decoded_")
