"""SentencePiece encoding and decoding, exact for merge-type (BPE) models, by backtracking.

Merging pairs from the best score down gives the one segmentation in which every two adjacent pieces are compatible:
merging the two of them afresh never joins anything across their boundary. So the segmentation is searched from left to
right. An Aho-Corasick pass finds the longest piece that starts at each place; a piece that is not compatible with the
one before it gives way to the next shorter piece, and where none is left the search steps back and marks that place in a
bitfield of failed positions, so no place fails twice and the work is linear in the text.

A text is cut beforehand where no piece of the model can reach across; short parts are remembered by the worker. Texts
are encoded as the model's normaliser without rules does it: a space before the text, spaces as U+2581, and characters
without a piece as the bytes of their UTF-8 form.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read_table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Parts of up to PART characters are remembered in two generations of PARTS, and up to PAIRS pairs.
PART, PARTS, PAIRS = 40, 400_000, 200_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Pieces:
    """Encoder and decoder of one merge-type model with byte fallback and no normalisation rules."""

    def __init__(self, pieces: list[tuple[str, float, int]], unknown: str = " \u2047 "):
        import ahocorasick

        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("a model with byte fallback is needed")
        forms = {NORMAL: lambda p: p.replace(SPACE, " "), UNKNOWN: lambda p: unknown}
        self.surface = [forms[kind](p).encode() if kind in forms else b"" for p, _, kind in pieces]
        self.spaced = [kind == NORMAL and p.startswith(SPACE) for p, _, kind in pieces]
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        usable = {p for p in self.ids if self._merges(p)[0] == len(p)}  # merging can give the others in no text
        for p in usable:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in usable), None) for p in usable}
        self.parts = self._parts()
        self.known, self.older, self.pairs = {}, {}, {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        # 2 is the merge type; user-defined (4) and unused (5) pieces change how pairs merge
        if model.trainer_spec.model_type != 2 or not plain or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only merge-type models without normalisation, user-defined or unused pieces")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.unk_surface)

    def _parts(self) -> re.Pattern:
        """A pattern of parts whose ends no piece reaches across, as far as this model allows.

        Spaces are taken to begin a part if no piece has one behind another character. ``apart`` are ASCII characters
        that share no piece with others, so they are split from both sides; ``after`` follow no ASCII letter within a
        piece, so a word of such letters ends before them.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(r"(?s).+")
        signs = {c for c in map(chr, range(128)) if not c.isalpha()}
        mixed = [p.lstrip(SPACE) for p in self.ids if len(p) > 1]
        apart = set(signs)
        while lost := {c for p in mixed if apart.intersection(p) and not apart.issuperset(p) for c in apart.intersection(p)}:
            apart -= lost
        after = signs - {b for p in mixed for a, b in zip(p, p[1:]) if a.isascii() and a.isalpha()}
        own, ends = ("".join(map(re.escape, sorted(chars))) for chars in (apart, after))
        forms = [f"[A-Za-z]+(?=[{SPACE}{ends}]|\\Z)", f"[^{SPACE}{own}]+", own and f"[{own}]+"]
        return re.compile("|".join(f"{SPACE}*{form}" for form in forms if form) + f"|{SPACE}+")

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` from its characters keeps the boundary between the two."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._merges(left + right, len(left)) is not None
        return found

    def _merges(self, text: str, boundary: int | None = None) -> dict[int, int] | None:
        """Start to end of the symbols that merging leaves; None as soon as a merge crosses ``boundary``."""
        ends = {i: i + 1 for i in range(len(text))}  # live symbols: start to end
        starts = {i + 1: i for i in range(len(text))}
        heap = []

        def offer(a: int, b: int) -> None:
            score = self.scores.get(text[a : ends[b]])
            if score is not None:
                heapq.heappush(heap, (-score, a, b, ends[b]))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if ends.get(a) != b or ends.get(b) != end:
                continue  # one of the two has merged since
            if b == boundary:
                return None
            del ends[b], starts[b]
            ends[a], starts[end] = end, a
            if a in starts:
                offer(starts[a], a)
            if end in ends:
                offer(a, end)
        return ends

    def split(self, text: str) -> list[str]:
        """Pieces of ``text``; a character without a piece is one of its own."""
        longest = [1] * len(text)
        for end, size in self.automaton.iter(text):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        failed = bytearray(len(text) + 1)
        out, at, size = [], 0, longest[0] if text else 0
        token = text[:size]
        while at < len(text):
            end = at + len(token)
            if not failed[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < len(text):
                    token = text[at : at + longest[at]]
                continue
            token = self.shorter.get(token)
            while token is None:  # nothing fits here: the piece before it was wrong
                failed[at] = 1
                token = out.pop()
                at -= len(token)
                token = self.shorter.get(token)
        return out

    def _ids(self, part: str) -> list[int]:
        found = []
        for piece in self.split(part):
            i = self.ids.get(piece)
            if i is None:
                found.extend(self.bytes[b] for b in piece.encode())
            else:
                found.append(i)
        return found

    def encode(self, text: str) -> list[int]:
        """All ids of ``text``, without begin or end ids; an empty text has none."""
        if not text:
            return []
        out, known = [], self.known
        for part in self.parts.findall(SPACE + text.replace(" ", SPACE)):
            ids = known.get(part)
            if ids is None:
                ids = self.older.get(part) or self._ids(part)
                if len(part) <= PART:
                    if len(known) >= PARTS:
                        self.older, self.known = known, {}
                        known = self.known
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: U+2581 as space, one space dropped in front, each byte of no character as U+FFFD."""
        surface = self.surface
        runs = [surface[i] for i in ids]
        if self.spaced[next((i for i in ids if surface[i]), 0)]:
            first = next(k for k, run in enumerate(runs) if run)
            runs[first] = runs[first][1:]
        if b"" not in runs:
            return _text(b"".join(runs))
        ends = [k for k, i in enumerate(ids) if not surface[i]]  # control pieces end a run of bytes
        return "".join(_text(b"".join(runs[a:b])) for a, b in zip([0, *ends], [*ends, len(runs)]))


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="each_byte")


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


_models: dict[str, Pieces] = {}


def model_of(path: str) -> Pieces:
    """One model for each worker process, kept from task to task."""
    if path not in _models:
        import codecs

        codecs.register_error("each_byte", _each_byte)
        _models[path] = Pieces.load(path)
    return _models[path]


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row of ``docs``, which has doc_id and text.

    Null and empty texts have no ids and decode to the empty text. Repeated and null identifiers stay as rows of their
    own; other columns are ignored, whatever their names; no rows give no rows. A text of any length is encoded whole;
    nothing is shuffled.
    """
    path = model or default_model()

    def work(batches):
        pieces = model_of(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 50):
                some = batch.slice(start, 50)
                ids = [pieces.encode(t or "") for t in some.column(1).to_pylist()]
                texts = [pieces.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def decoded(coded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids decode to null, null within ids is passed over."""
    path = model or default_model()

    def work(batches):
        pieces = model_of(path)
        for batch in batches:
            texts = [None if ids is None else pieces.decode([i for i in ids if i is not None]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(work, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
