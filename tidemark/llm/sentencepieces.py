"""SentencePiece encoding and decoding, with giant documents split into chunks.

A segmentation is the model's encoding exactly when each pair of neighbouring pieces is: merging the two pieces' text alone
must give the two pieces back. So encoding is a path of weight 0 in a graph whose edges weigh 0 for such pairs and minus
infinity otherwise, and prefixes are combined in the max-plus semiring with the last piece as state.

A document longer than GIANT is cut into chunks of CHUNK characters. A boundary state is the piece that ends at or reaches
over a boundary. Each chunk yields the transfer matrix between the possible states at its two boundaries, kept as the
finite entries of its rows; matrices of neighbouring chunks are multiplied in blocks, blocks are scanned per document, and the
states found go back to the chunks, which then trace their pieces each on its own. Documents up to GIANT need no boundary and
are encoded by the library in one piece.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import row_key, staged, text_of

GIANT = 1 << 16
CHUNK = 1 << 14
#: Chunks whose matrices one task multiplies.
BLOCK = 64
#: Texts that are encoded at once, and pairs of pieces that a task remembers.
LOT = 64
REMEMBERED = 200_000
#: What the model writes for a space.
MARK = "\u2581"


class Pieces:
    """The merge rules of a SentencePiece BPE model with byte fallback, an identity normaliser and a leading mark."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        p = self.processor
        special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in range(p.get_piece_size())]
        self.ids = {p.id_to_piece(i): i for i, out in enumerate(special) if not out}
        self.scores = {piece: p.get_score(i) for piece, i in self.ids.items()}
        self.bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        marks = [score for piece, score in self.scores.items() if len(piece) > 1 and not piece.strip(MARK)]
        if any(MARK in piece[1:] and piece.strip(MARK) for piece in self.ids) or max(marks, default=-1e30) >= min(score for piece, score in self.scores.items() if piece.strip(MARK)):
            raise ValueError("marks of this model merge with what stands before them, or too early")
        self.known: dict[tuple[str, str], bool] = {}
        self.wholes: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text: the neighbours with the best joint score merge, the leftmost of equals first."""
        parts = list(text)
        while len(parts) > 1:
            joint = [self.scores.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = max((s for s in joint if s is not None), default=None)
            if best is None:
                break
            at = joint.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, piece: str) -> bool:
        """Whether the text is one piece; a character outside the vocabulary counts as one."""
        if len(piece) == 1:
            return True
        if piece not in self.scores:
            return False
        found = self.wholes.get(piece)
        if found is None:
            found = self.wholes[piece] = len(self.merge(piece)) == 1
        return found

    def fits(self, before: str, piece: str) -> bool:
        """Whether the two pieces may follow one another: the weight is 0, else minus infinity."""
        if not before:
            return True
        found = self.known.get((before, piece))
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            found = self.known[before, piece] = self.merge(before + piece) == [before, piece]
        return found

    def numbers(self, pieces: list[str], hollow: str, runs: list[int]) -> list[int]:
        """Ids of the pieces; ``hollow`` stands for the next of ``runs`` marks, and for one more if a lone mark follows."""
        out: list[int] = []
        left = iter(runs)
        at = 0
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece == hollow:
                marks = next(left)
                if at < len(pieces) and pieces[at] == MARK:
                    marks, at = marks + 1, at + 1
                # the library puts one mark in front
                out.extend(self.processor.encode(" " * (marks - 1)) if marks > 1 else [self.ids[MARK]])
            elif piece in self.ids:
                out.append(self.ids[piece])
            else:
                out.extend(self.bytes[b] for b in piece.encode())
        return out


class Cut:
    """A text in chunks. Marks merge last and all alike, leftmost first, so which of a run's marks join depends on the run's
    length; a run of two or more is written as one ``hollow`` character, in place of all its marks but the last."""

    def __init__(self, text: str, chunk: int, reach: int):
        self.hollow = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in text)
        marked = MARK + text.replace(" ", MARK)
        lengths = [len(m) - 1 for m in re.findall(MARK + "{2,}", marked)]
        self.text = re.sub(MARK + "{2,}", self.hollow + MARK, marked)
        self.chunk, self.reach = chunk, reach
        self.starts, at = [], 0
        while at < len(self.text):
            self.starts.append(at)
            at += chunk
            # a hollow character and the mark behind it stay in one chunk
            at += at <= len(self.text) and self.text[at - 1] == self.hollow
        self.lengths = iter(lengths)

    def pieces(self) -> Iterator[tuple[str, int, int, list[int]]]:
        """Context, start and width of each chunk in it, and the runs in the chunk."""
        for start, stop in zip(self.starts, [*self.starts[1:], len(self.text)], strict=True):
            runs = [next(self.lengths) for _ in range(self.text.count(self.hollow, start, stop))]
            yield self.text[max(start - self.reach, 0) : stop + self.reach], min(start, self.reach), stop - start, runs


State = tuple[int, str]


def boundary_states(pieces: Pieces, text: str, at: int) -> list[State]:
    """All states a boundary can have: (characters that the last piece reaches over it, that piece). At 0, the start alone."""
    if at == 0:
        return [(0, "")]
    out = []
    for over in range(min(pieces.longest, len(text) - at + 1)):
        for length in range(over + 1, min(pieces.longest, at + over) + 1):
            piece = text[at + over - length : at + over]
            if pieces.whole(piece):
                out.append((over, piece))
    return out


def _run(pieces: Pieces, text: str, start: int, stop: int, entry: State, reference: list[str | None] | None) -> list[str | None]:
    """The last piece of each prefix of text[start:], after ``entry``, over pieces that start before ``stop``.

    Only ``longest`` positions are looked back on; once so many equal those of ``reference``, all later ones do.
    """
    over, first = entry
    width = stop - start
    size = min(width + pieces.longest - 1, len(text) - start)
    last: list[str | None] = [None] * (size + 1)
    last[over] = first
    longest, whole, fits = pieces.longest, pieces.whole, pieces.fits
    same = 0
    for p in range(over + 1, size + 1):
        for length in range(min(longest, p - over), 0, -1):
            q = p - length
            if q >= width:
                break
            before = last[q]
            if before is None:
                continue
            piece = text[start + q : start + p]
            if whole(piece) and fits(before, piece):
                last[p] = piece
                break
        if reference is not None:
            same = same + 1 if last[p] == reference[p] else 0
            if same >= longest:
                last[p + 1 :] = reference[p + 1 :]
                break
    return last


def transfer(pieces: Pieces, text: str, start: int, stop: int) -> list[tuple[State, list[State]]]:
    """The finite entries of the transfer matrix of text[start:stop]: for each entry state the exit states."""
    out, reference = [], None
    for entry in boundary_states(pieces, text, start):
        last = _run(pieces, text, start, stop, entry, reference)
        exits = [(p - (stop - start), piece) for p, piece in enumerate(last) if p >= stop - start and piece is not None]
        if exits:
            out.append((entry, exits))
            reference = reference or last
    return out


def multiply(left: dict[State, set[State]], right: dict[State, set[State]]) -> dict[State, set[State]]:
    """Product of two transfer matrices; associative."""
    return {a: found for a, middle in left.items() if (found := set().union(*(right.get(m, set()) for m in middle)))}


def walk(matrices: list[dict[State, set[State]]], entries: set[State], goal: State) -> list[State]:
    """States at the boundaries before each matrix, on the path from one of ``entries`` to ``goal``."""
    reached = [entries]
    for matrix in matrices:
        reached.append(set().union(*(matrix.get(s, set()) for s in reached[-1])))
    path = [goal]
    for matrix, before in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        path.append(next(s for s in sorted(before) if path[-1] in matrix.get(s, ())))
    return path[:0:-1]


def trace(pieces: Pieces, text: str, start: int, stop: int, entry: State, goal: State) -> list[str]:
    """The pieces that start in text[start:stop], between two states."""
    last = _run(pieces, text, start, stop, entry, None)
    out, p = [], stop - start + goal[0]
    while p > entry[0]:
        out.append(last[p])
        p -= len(last[p])
    return out[::-1]


def _packed(matrix: dict[State, set[State]]) -> str:
    return json.dumps([[a, sorted(b)] for a, b in sorted(matrix.items())])


def _unpacked(text: str) -> dict[State, set[State]]:
    return {tuple(a): {tuple(x) for x in b} for a, b in json.loads(text)}


#: A plain dictionary, which travels to the tasks by value with the function below; a cache of functools would be looked up by name.
_KNOWN: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    if model not in _KNOWN:
        _KNOWN[model] = Pieces(model)
    return _KNOWN[model]


def _giants(rows: DataFrame, model: bytes, chunk: int, block: int) -> DataFrame:
    """(k1, k2, ids, n_chunks) of long texts. ``rows`` has k1, k2 and text, one row per key."""
    key = ["k1", "k2"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reach = _pieces(model).longest
        for batch in batches:
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                whole = Cut(text, chunk, reach)
                rows = ((k1, k2, n, *part, whole.hollow, len(whole.starts)) for n, part in enumerate(whole.pieces()))
                while found := list(islice(rows, BLOCK)):
                    yield pd.DataFrame(found, columns=["k1", "k2", "n", "text", "start", "width", "runs", "hollow", "n_chunks"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrices = [_packed({a: set(b) for a, b in transfer(_pieces(model), t, s, s + w)}) for t, s, w in zip(batch["text"], batch["start"], batch["width"], strict=True)]
            yield batch[["k1", "k2", "n", "n_chunks"]].assign(matrix=matrices)

    def product(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        total = None
        for matrix in map(_unpacked, group["matrix"]):
            total = matrix if total is None else multiply(total, matrix)
        return group.head(1)[["k1", "k2", "block"]].assign(matrix=_packed(total))

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        matrices = [_unpacked(m) for m in group["matrix"]]
        goal = next(iter(set().union(*_ends(matrices))))
        path = [*walk(matrices, {(0, "")}, goal), goal]
        return group[["k1", "k2", "block"]].assign(entry=[json.dumps(s) for s in path[:-1]], goal=[json.dumps(s) for s in path[1:]])

    def _ends(matrices):
        reached = {(0, "")}
        for matrix in matrices:
            reached = set().union(*(matrix.get(s, set()) for s in reached))
        return [{s for s in reached if s[0] == 0}]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n")
        entry, goal = (tuple(json.loads(group[c].iloc[0])) for c in ("entry", "goal"))
        path = [*walk([_unpacked(m) for m in group["matrix"]], {entry}, goal), goal]
        return group[["k1", "k2", "n"]].assign(entry=[json.dumps(s) for s in path[:-1]], goal=[json.dumps(s) for s in path[1:]])

    def backtrace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(model)
        for batch in batches:
            ids = [pieces.numbers(trace(pieces, r.text, r.start, r.start + r.width, tuple(json.loads(r.entry)), tuple(json.loads(r.goal))), r.hollow, list(r.runs)) for r in batch.itertuples(index=False)]
            yield batch[["k1", "k2", "n", "n_chunks"]].assign(ids=ids)

    chunks = staged(rows.mapInPandas(cut, "k1 long, k2 long, n long, text string, start int, width int, runs array<int>, hollow string, n_chunks long"), "pieces-chunks")
    # chunks are few bytes and much work: a number of partitions that is named is not merged
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matrices = chunks.repartition(tasks, "k1", "k2", "n").mapInPandas(measure, "k1 long, k2 long, n long, n_chunks long, matrix string")
    matrices = staged(matrices.withColumn("block", F.floor(F.col("n") / block)), "pieces-matrices")
    blocks = matrices.groupBy(*key, "block").applyInPandas(product, "k1 long, k2 long, block long, matrix string")
    ends = blocks.groupBy(*key).applyInPandas(scan, "k1 long, k2 long, block long, entry string, goal string")
    states = matrices.join(ends, [*key, "block"]).groupBy(*key, "block").applyInPandas(place, "k1 long, k2 long, n long, entry string, goal string")
    traced = chunks.join(states, [*key, "n"]).repartition(tasks, *key, "n").mapInPandas(backtrace, "k1 long, k2 long, n long, n_chunks long, ids array<int>")
    # the result is one array per document, so its parts must meet
    return traced.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("ids"), F.max("n_chunks").alias("n_chunks"))


def _whole(rows: DataFrame, model: bytes, keep_text: bool) -> DataFrame:
    """Texts that need no inner boundary, in lots, so that a task holds the ids of a few texts only."""
    kept = [c for c in rows.columns if keep_text or c != "text"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_chunks", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            for start in range(0, batch.num_rows, LOT):
                lot = batch.slice(start, LOT)
                texts = [text or "" for text in lot.column("text").to_pylist()]
                ids = processor.encode(texts, num_threads=1)
                same = [a == b for a, b in zip(processor.decode(ids, num_threads=1), texts, strict=True)]
                columns = [lot.column(c) for c in kept] + [pa.array(ids, pa.list_(pa.int32())), pa.array([1] * len(texts), pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "ids", "n_chunks", "round_trip"])

    return rows.mapInArrow(encode, schema)


def encoded(docs: DataFrame, model_file: str, giant: int = GIANT, chunk: int = CHUNK, block: int = BLOCK, keep_text: bool = True) -> DataFrame:
    """``docs`` plus ids, the model's encoding of the whole text, n_chunks, 1 for texts of up to ``giant`` characters, and
    round_trip: whether decoding the ids gives the text again.

    ``model_file`` is read on the driver and travels to the tasks. Null and empty texts have no ids. Rows equal in every
    column are encoded alike. An empty table gives no rows. Columns named like the new ones are replaced; the text itself is
    left out unless ``keep_text``.
    """
    with open(model_file, "rb") as f:
        model = f.read()
    names = [c for c in docs.columns if c not in ("ids", "n_chunks", "round_trip")]
    kept = [F.col(f"`{c}`") for c in names if keep_text or c != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    small = _whole(rows.where(F.length(text_of("text")) <= giant), model, keep_text)
    keyed = rows.where(F.length(text_of("text")) > giant).withColumn("__k1", row_key(rows, 1)).withColumn("__k2", row_key(rows, 2))
    found = _giants(keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), "text").dropDuplicates(["k1", "k2"]), model, chunk, block)
    large = decoded(keyed.join(found, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2"))), model_file)
    return small.unionByName(large.select(*kept, "ids", "n_chunks", (F.col("decoded") == F.col("text")).alias("round_trip")))


def decoded(rows: DataFrame, model_file: str) -> DataFrame:
    """``rows`` plus decoded, the text of the array column ids; null ids give null.

    Texts come back as they were, but for U+2581, which the model cannot tell from a space.
    """
    with open(model_file, "rb") as f:
        model = f.read()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            yield pd.Series([None if ids is None else processor.decode(np.asarray(ids).tolist()) for ids in batch], dtype=object)

    return rows.withColumn("decoded", text(F.col("ids")))


def encoded_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids, n_chunks and round_trip of every document."""
    out = encoded(docs.select("doc_id", "text"), model_file, keep_text=False)
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "n_chunks", "round_trip")
