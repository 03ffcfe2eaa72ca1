"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

Documents are tokenised, given an end id and cut: whole windows first, then what is left in fragments of at most
``FRAGMENT`` ids. Fragments gather in blocks of ``BLOCK`` within a task. A block needs ceil(total / window) windows at
least; differencing starts from one partial partition per fragment and always merges the two whose fullest and emptiest
windows differ most, fullest onto emptiest, so that opposing imbalances cancel. If the fullest window of the result
exceeds the capacity, the number of windows rises by one and the block is partitioned again.

Nothing is shuffled and a task holds one block, so the work grows with the input and not with any source or document.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read_table
from .textvec import release

WINDOW = 1024
FRAGMENT = 256
BLOCK = 512
END_ID = 0
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def default_vocabulary() -> tuple[str, str]:
    """Where the tokenizer's file is, and that of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)


class Encoder:
    """Ids of whole texts as the ``tokenizers`` library gives them without added special tokens.

    The same vocabulary as ranks gives the same ids in about a fifth of the time, so texts are encoded with those; the
    tokenizer itself takes the texts that this cannot handle, and a probe of both at the start makes sure they agree.
    After the probe it is dropped, and read again by the first text that needs it.
    """

    PROBE = "It's 1 tEst\n\n of  <|endoftext|>, naïve \u3042\u00a0 \U0001f600 ids\t\r\n."

    def __init__(self, vocabulary: str, ranks: str | None):
        self.vocabulary = vocabulary
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
            if fast.encode(self.PROBE, allowed_special="all") == self._slow(self.PROBE).tolist():
                self.fast = fast
                del self.tokenizer
        release()

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.fast is None or _HARD.search(text):
            return self._slow(text).tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


#: Long white space exceeds the backtracking limit of the fast encoder's pattern.
_HARD = re.compile(r"\s{1000}")
_encoders: dict[tuple, Encoder] = {}


def encoder_of(vocabulary: tuple[str, str | None]) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(*vocabulary)
    return _encoders[vocabulary]


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the indexes of ``sizes`` dealt to ``windows`` near-equal parts.

    A partial partition keeps its non-empty windows only, so a merge costs as many steps as it has of them.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # both have the fullest window first; counted with their empty windows, one's k-th meets the other's k-th from last
        free = windows - len(a)
        over = len(b) - free
        if over <= 0:
            merged = a + b
        else:
            merged = a[: len(a) - over] + b[:free]
            for k in range(over):
                sa, ia = a[len(a) - 1 - k]
                sb, ib = b[free + k]
                merged.append((sa + sb, ia + ib))
        merged.sort(key=lambda w: -w[0])
        if len(merged) == windows:
            least = merged[-1][0]
            heapq.heappush(heap, (least - merged[0][0], tick, merged))
        else:
            heapq.heappush(heap, (-merged[0][0], tick, merged))
        tick += 1
    return [w[1] for w in heap[0][2]] if heap else []


def balance(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Near-equal parts of at most ``capacity``, as few as differencing manages."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, windows)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        windows += 1


SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def packed(docs: DataFrame, vocabulary: tuple[str, str | None] | None = None, window: int = WINDOW, fragment: int = FRAGMENT, block: int = BLOCK, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if wanted).

    Null text counts as empty: one end id, packed like any other. Rows that repeat an identifier or a text are packed
    each. No rows give no rows; other columns are ignored. Sequence numbers are unique, not consecutive: the partition in
    the upper bits, a counter in the lower 33.
    """
    path = vocabulary or default_vocabulary()

    def work(batches):
        from pyspark import TaskContext

        encoder = encoder_of(path)
        sequence = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []

        def emit(pieces):
            columns = list(zip(*pieces, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                return pa.RecordBatch.from_arrays([*arrays, pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in columns[7]], pa.list_(pa.int32()))], names=[*SCHEMA.names, "ids"])
            return pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)

        def close(group):
            nonlocal sequence
            out = []
            for part in balance([p[2] for p in group], window):
                offset = 0
                for i in sorted(part):
                    doc, start, length, crc, total, raw = group[i]
                    out.append((doc, start, length, crc, total, sequence, offset, raw))
                    offset += length
                sequence += 1
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(ids), 256):
                out = []
                for doc, text in zip(ids[lo : lo + 256], texts[lo : lo + 256], strict=True):
                    data = encoder.encode(text or "") + END_ID.to_bytes(4, "little")
                    total = len(data) // 4
                    whole = total // window * window
                    for start in range(0, whole, window):
                        raw = data[4 * start : 4 * (start + window)]
                        out.append((doc, start, window, zlib.crc32(raw), total, sequence, 0, raw if with_ids else None))
                        sequence += 1
                    for start in range(whole, total, fragment):
                        raw = data[4 * start : 4 * (start + fragment)]
                        waiting.append((doc, start, len(raw) // 4, zlib.crc32(raw), total, raw if with_ids else None))
                while len(waiting) >= block:
                    out += close(waiting[:block])
                    del waiting[:block]
                if out:
                    yield emit(out)
        if waiting:
            yield emit(close(waiting))

    columns = ", ".join(f"{n} long" for n in SCHEMA.names) + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))
