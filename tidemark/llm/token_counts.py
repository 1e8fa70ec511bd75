"""Token counts by a finite-state machine compiled from a BPE vocabulary with word ends.

**Transducer.** A state reads one character and has emitted a number of tokens. It is made of the pre-tokenizer's place (between words,
in letters, in other signs, behind an apostrophe that may begin a contraction) and, inside a word, of items: one for each place from
which a token may still reach the next byte, with the trie node of the bytes since, the last token of the encoding up to that place
and how many tokens that has, less the smallest such number, which is emitted. BPE encodes a prefix of a word as one prefix of the
encoding's tokens, and a segmentation is the encoding when every two neighbours are, so exactly one item yields the last token at the
next place. Case folding, bytes and the class of a character are folded into the transitions, which are compiled when first taken and
kept; a state's first steps ask the library about single characters, so its rules hold.

**State maps.** A chunk of a text sends every state over its head, the characters up to the first one between words; from there on all
states are the same one, so a map is (head, tokens behind it, last state), or a head alone. Maps compose associatively. Chunks are cut
where normalisation cannot join characters. They are mapped in the task that reads them, those behind the first block of a long text
after the exchange; each block's maps are reduced in a task of its own, then the blocks of a document.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_of

#: Characters of a chunk at least, but for the last one.
CHUNK = 1024
#: Chunks of a block.
BLOCK = 256
#: States kept by a task; beyond, they are compiled anew.
STATES = 200_000
#: Rows handed on at once.
LOT = 4096
#: Tokens below a trie node up to which items are told apart by what may follow instead of by their last token.
NARROW = 16
#: Longest special token; a chunk never ends so close behind a "<".
SPECIAL = 16

#: A chunk ends before ASCII, Greek, Cyrillic, kana, ideographs or Hangul syllables, none of which joins what stands before it, and not
#: inside what may be a special token.
_CUT = r"(?s).{%d}.*?(?:(?<!<[^<]{0,%d})(?=[\x00-\x7fΑ-ϿЀ-҂Ҋ-ԯぁ-ゖァ-ヺ一-鿿가-힣])|\z)|.+"

BETWEEN, LETTERS, SIGNS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
#: The contractions of the pre-tokenizer's pattern: fixed values.
_SHORT = {"s", "t", "m", "d"}
_LONG = {"r": (QUOTE_R, "e"), "v": (QUOTE_V, "e"), "l": (QUOTE_L, "l")}
_WAITING = {mode: (first, second) for first, (mode, second) in _LONG.items()}


class Vocabulary:
    """Tokens as symbols: a byte inside a word, 256 + byte at its end."""

    def __init__(self, model: dict) -> None:
        suffix = model["end_of_word_suffix"]
        # the byte alphabet: printable Latin-1 stands for itself, the rest follows from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}

        def symbols(token: str) -> tuple[int, ...]:
            last = token.endswith(suffix)
            found = [letters[c] for c in (token[: -len(suffix)] if last else token)]
            return tuple(found[:-1]) + (found[-1] + 256,) if last else tuple(found)

        vocabulary = {token: n for token, n in model["vocab"].items() if all(c in letters for c in token.removesuffix(suffix)) and token.removesuffix(suffix)}
        self.symbols = {n: symbols(token) for token, n in vocabulary.items()}
        self.single = {s[0]: n for n, s in self.symbols.items() if len(s) == 1}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        #: token -> rank of the rule that makes it, and its two parts
        self.made = {whole: (rank, *pair) for pair, (rank, whole) in self.merges.items()}
        if len(self.made) != len(self.merges):
            raise ValueError("two rules make the same token")
        self.next: dict[tuple[int, int], int] = {}
        self.token: list[int | None] = [None]
        self.inner = [False]
        for n, path in sorted(self.symbols.items()):
            node = 0
            for s in path:
                self.inner[node] = True
                if (node, s) not in self.next:
                    self.next[node, s] = len(self.token)
                    self.token.append(None)
                    self.inner.append(False)
                node = self.next[node, s]
            self.token[node] = n
        self.fits: dict[tuple[int, int], bool] = {}
        #: node -> tokens below it, for nodes with at most ``NARROW`` of them
        self.below: dict[int, list[int]] = {}
        parents = {child: node for (node, _), child in self.next.items()}
        for node, token in enumerate(self.token):
            if token is not None:
                up = parents[node]
                while up and len(self.below.setdefault(up, [])) <= NARROW:
                    self.below[up].append(token)
                    up = parents[up]
        self.stand: dict[tuple[int, int], int | None] = {}
        self.like: dict[tuple[int, ...], int] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """The ids after all merges, the first rule first and the leftmost pair first."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as itself."""
        return self.merged([self.single[s] for s in self.symbols[token]]) == [token]

    def _apart(self, left: int, right: int) -> bool:
        """Whether the bytes of two such tokens in a row are encoded as the two.

        The merges that made them are undone, the latest first; before each, the pieces that then met must not have had an earlier
        merge of their own. Of equal rules the left one came first.
        """
        if (left, right) in self.merges:
            return False
        while True:
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                left = a[2]
                met = self.merges.get((left, right))
                if met is not None and met[0] < a[0]:
                    return False
            else:
                right = b[1]
                met = self.merges.get((left, right))
                if met is not None and met[0] <= b[0]:
                    return False

    def forget(self) -> None:
        """Lets go of what is computed when needed."""
        self.fits, self.stand, self.like = {}, {}, {}

    def stands(self, node: int, last: int) -> int | None:
        """A last token that stands for ``last`` in items at ``node``, because the same tokens below it may follow; None if none may."""
        found = self.stand.get((node, last), -2)
        if found == -2:
            below = self.below[node]
            found = last
            if len(below) <= NARROW:
                # asked once for each node, so only what is true of a token alone is kept
                follow = [t for t in below if self.fit(-1, t) and (last < 0 or self._apart(last, t))]
                found = self.like.setdefault((node, *follow), last) if follow else None
            self.stand[node, last] = found
        return found

    def fit(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: begin a word)."""
        found = self.fits.get((last, token))
        if found is None:
            found = self.fit(-1, token) and self._apart(last, token) if last >= 0 else self._whole(token)
            self.fits[last, token] = found
        return found


class State(dict):
    """Character -> (state, tokens emitted); ``key`` tells the state to any task: mode, held byte and the items."""

    __slots__ = ("key", "machine", "rest")

    def __init__(self, machine: Machine, key: tuple[int, ...]) -> None:
        self.machine, self.key = machine, key
        self.rest: int | None = None

    def __missing__(self, c: str) -> tuple[State, int]:
        state, tokens = self.machine.step(self, c)
        self[c] = state, tokens
        return state, tokens


class Map(NamedTuple):
    """Sends a state over ``head``; if ``tail`` is there, the word then ends, ``tokens`` follow, and the state is ``tail``."""

    head: str
    tokens: int
    tail: tuple[int, ...] | None


class Machine:
    def __init__(self, tokenizer: str) -> None:
        parsed = json.loads(tokenizer)
        self.library = tokenizers.Tokenizer.from_str(tokenizer)
        self.vocabulary = Vocabulary(parsed["model"])
        self.specials = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        if max(map(len, self.specials), default=0) > SPECIAL or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].startswith("<") for t in parsed["added_tokens"]):
            raise ValueError("special tokens must be plain strings of at most 16 characters that begin with <")
        self.units: dict[str, list[tuple[int, str]]] = {}
        self.states: dict[tuple[int, ...], State] = {}
        self.between = self.state((BETWEEN,))

    def state(self, key: tuple[int, ...]) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, key)
        return found

    # characters

    def unit(self, c: str) -> list[tuple[int, str]]:
        """Class and folded form of a character, as the library has them; mode BETWEEN for white space, -1 for digits."""
        found = self.units.get(c)
        if found is None:
            split = self.library.pre_tokenizer.pre_tokenize_str
            found = []
            for d in self.library.normalizer.normalize_str(c):
                pieces = len(split(f"a{d}a"))
                found.append((BETWEEN if pieces == 2 else LETTERS if pieces == 1 else SIGNS if len(split(f"!{d}")) == 1 else -1, d))
            self.units[c] = found
        return found

    # words

    def _open(self, mode: int, text: str) -> tuple[tuple[int, ...], int]:
        """Key and emitted tokens of a word that begins with ``text``."""
        data = text.encode()
        return self._more((mode, data[0], 0, -1, 0), data[1:])

    def _more(self, key: tuple[int, ...], data: bytes) -> tuple[tuple[int, ...], int]:
        emitted = 0
        for b in data:
            items, last, count = [], None, 0
            for k in range(2, len(key), 3):
                node = self.vocabulary.next.get((key[k], key[1]))
                if node is None:
                    continue
                if self.vocabulary.inner[node]:
                    last_of = self.vocabulary.stands(node, key[k + 1])
                    if last_of is not None:
                        items.append((node, last_of, key[k + 2]))
                token = self.vocabulary.token[node]
                if last is None and token is not None and self.vocabulary.fit(key[k + 1], token):
                    last, count = token, key[k + 2] + 1
            items.append((0, last, count))
            least = min(i[2] for i in items)
            emitted += least
            key = (key[0], b, *[v for node, last, count in items for v in (node, last, count - least)])
        return key, emitted

    def _closed(self, key: tuple[int, ...]) -> int:
        """Tokens of the open word that are not emitted yet, if it ends here."""
        for k in range(2, len(key), 3):
            node = self.vocabulary.next.get((key[k], key[1] + 256))
            token = None if node is None else self.vocabulary.token[node]
            if token is not None and self.vocabulary.fit(key[k + 1], token):
                return key[k + 2] + 1
        raise ValueError("a byte has no token of its own")

    def _word(self, mode: int, text: str) -> int:
        key, emitted = self._open(mode, text)
        return emitted + self._closed(key)

    def rest(self, state: State) -> int:
        """Tokens still to come if the text ends in ``state``."""
        if state.rest is None:
            mode = state.key[0]
            if mode == BETWEEN:
                state.rest = 0
            elif mode in (LETTERS, SIGNS):
                state.rest = self._closed(state.key)
            else:
                state.rest = self._word(SIGNS, "'") + (self._word(LETTERS, _WAITING[mode][0]) if mode in _WAITING else 0)
        return state.rest

    # transitions

    def step(self, state: State, c: str) -> tuple[State, int]:
        key, tokens = state.key, 0
        for kind, d in self.unit(c):
            key, emitted = self._step(key, kind, d)
            tokens += emitted
        return self.state(key), tokens

    def _step(self, key: tuple[int, ...], kind: int, d: str) -> tuple[tuple[int, ...], int]:
        mode = key[0]
        if mode == kind and mode in (LETTERS, SIGNS):
            return self._more(key, d.encode())
        if mode == QUOTE:
            if d in _SHORT:
                return (BETWEEN,), self._word(SIGNS, "'" + d)
            if d in _LONG:
                return (_LONG[d][0],), 0
            if kind == SIGNS:
                return self._open(SIGNS, "'" + d)
        elif mode in _WAITING:
            first, second = _WAITING[mode]
            if d == second:
                return (BETWEEN,), self._word(SIGNS, "'" + first + second)
            after, emitted = self._open(LETTERS, first)
            after, more = self._step(after, kind, d)
            return after, self._word(SIGNS, "'") + emitted + more
        done = self.rest(self.state(key))
        if kind == BETWEEN:
            return (BETWEEN,), done
        if kind == LETTERS or (kind == SIGNS and d != "'"):
            after, emitted = self._open(kind, d)
            return after, done + emitted
        return ((QUOTE,), done) if kind == SIGNS else ((BETWEEN,), done + self._word(LETTERS, d))

    # texts

    def _parts(self, text: str) -> list[str | None]:
        """The text between special tokens, normalised, with None for each of these."""
        parts: list[str | None] = [text]
        if "<" in text:
            for special in self.specials:
                cut: list[str | None] = []
                for part in parts:
                    for i, piece in enumerate([None] if part is None else part.split(special)):
                        cut += [None, piece] if i else [piece]
                parts = cut
        composed = self.library.normalizer[0].normalize_str
        return [p if p is None or p.isascii() or unicodedata.is_normalized("NFC", p) else composed(p) for p in parts]

    def over(self, state: State, text: str) -> tuple[State, int]:
        tokens = 0
        for c in text:
            state, k = state[c]
            tokens += k
        return state, tokens

    def map_of(self, chunk: str) -> Map:
        if len(self.states) > STATES:
            self.states = {}
            self.vocabulary.forget()
            self.between = self.state((BETWEEN,))
        head, tokens, state = "", 0, None
        for part in self._parts(chunk):
            if part is None:
                tokens += 1 + (0 if state is None else self.rest(state))
                state = self.between
                continue
            if state is None:
                end = next((i for i, c in enumerate(part) if self.unit(c)[0][0] in (BETWEEN, -1)), None)
                head = part if end is None else part[:end]
                if end is None:
                    continue
                part, state = part[end:], self.between
            state, k = self.over(state, part)
            tokens += k
        return Map(head, tokens, None if state is None else state.key)

    def joined(self, a: Map, b: Map) -> Map:
        """The map of a text followed by another's."""
        if a.tail is None:
            return Map(a.head + b.head, b.tokens, b.tail)
        state, k = self.over(self.state(a.tail), b.head)
        if b.tail is None:
            return Map(a.head, a.tokens + k, state.key)
        return Map(a.head, a.tokens + k + self.rest(state) + b.tokens, b.tail)

    def begun(self, whole: Map) -> Map:
        """The map of a text that nothing precedes: the same state for every one before it."""
        state, tokens = self.over(self.between, whole.head)
        return Map("", tokens, state.key) if whole.tail is None else Map("", tokens + self.rest(state) + whole.tokens, whole.tail)

    def counted(self, whole: Map) -> int:
        """Tokens of a text with this map."""
        whole = self.begun(whole)
        return whole.tokens + self.rest(self.state(whole.tail))


def machine_of(tokenizer: str) -> Machine:
    """The machine of a tokenizer; a worker process keeps the last one, so that a task goes on with what earlier ones compiled.

    Tasks get their functions by value, so the place to keep it is a module of the process, not one of this package.
    """
    kept = sys.modules.setdefault("kept_token_machine", types.ModuleType("kept_token_machine"))
    if getattr(kept, "tokenizer", None) != tokenizer:
        kept.machine, kept.tokenizer = Machine(tokenizer), tokenizer
    return kept.machine


_MAP = [T.StructField("head", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("tail", T.ArrayType(T.IntegerType()))]
_TYPES = {"head": pa.string(), "tokens": pa.int64(), "tail": pa.list_(pa.int32())}


def with_token_counts(docs: DataFrame, tokenizer_file: str, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """The columns of ``docs`` without its text, plus n_tokens: how many tokens the tokenizer gives for the whole text.

    ``tokenizer_file`` is a BPE vocabulary with word ends, byte alphabet and contractions; it is read on the driver, a few MB, and
    travels to the tasks. No token is added to a text; special tokens written out in it count as one each. Null and empty texts
    have none. Rows are told apart by their place in the scan, so repeated rows stay, each with its count. An empty table gives no
    rows. A column n_tokens is replaced, all others but the text are kept.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = f.read()
    kept = [c for c in docs.columns if c not in ("text", "n_tokens")]
    row = T.StructType([docs.schema[c] for c in kept])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(text_of("text").alias("text"), F.monotonically_increasing_id().alias("key"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    cut = F.regexp_extract_all("text", F.lit(_CUT % (chunk, SPECIAL)), F.lit(0))
    chunks = texts.select("key", "row", F.posexplode_outer(cut).alias("n", "chunk"))
    # the row travels with the first chunk alone
    n = F.coalesce("n", F.lit(0))
    chunks = chunks.select("key", F.floor(n / block).cast("int").alias("block"), n.alias("n"), F.coalesce("chunk", F.lit("")).alias("chunk"), F.when(n == 0, F.col("row")).alias("row"))

    def batch_of(keys: dict, maps: list[Map], row) -> pa.RecordBatch:
        columns = {**keys, **{f: pa.array([getattr(m, f) for m in maps], _TYPES[f]) for f in Map._fields}, "row": row}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def read(batch: pa.RecordBatch) -> Iterator[Map]:
        for head, tokens, tail in zip(*[batch.column(f).to_pylist() for f in Map._fields], strict=True):
            yield Map(head, tokens, None if tail is None else tuple(tail))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(tokenizer)
        for batch in batches:
            # fewer than no tokens: a chunk that is still to be mapped
            maps = [machine.map_of(c) if b == 0 else Map(c, -1, None) for c, b in zip(batch.column("chunk").to_pylist(), batch.column("block").to_pylist(), strict=True)]
            yield batch_of({c: batch.column(c) for c in ("key", "block", "n")}, maps, batch.column("row"))

    def reduce_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A map for each run of equal (key, block), with the row of its first chunk and the tokens if the text ends there."""
        machine = machine_of(tokenizer)

        def full(done: list[tuple]) -> pa.RecordBatch:
            maps = [machine.begun(whole) if block == 0 else whole for _, block, whole, _ in done]
            rests = [None if m.tail is None else machine.rest(machine.state(m.tail)) for m in maps]
            keys = {"key": pa.array([d[0] for d in done], pa.int64()), "block": pa.array([d[1] for d in done], pa.int32()), "rest": pa.array(rests, pa.int64())}
            return batch_of(keys, maps, pa.chunked_array([d[3] for d in done]).combine_chunks())

        done: list[tuple] = []
        for batch in batches:
            for i, (key, block, fresh) in enumerate(zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), read(batch), strict=True)):
                fresh = machine.map_of(fresh.head) if fresh.tokens < 0 else fresh
                if done and done[-1][:2] == (key, block):
                    done[-1] = (key, block, machine.joined(done[-1][2], fresh), done[-1][3])
                    continue
                if len(done) >= LOT:
                    yield full(done)
                    done = []
                done.append((key, block, fresh, batch.column("row").slice(i, 1)))
        if done:
            yield full(done)

    def reduce_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of each run of equal keys; a document of one block has its count already."""
        machine = None

        def full(done: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.chunked_array([d[3] for d in done]).combine_chunks(), pa.array([d[1].tokens + d[2] for d in done], pa.int64())], ["row", "n_tokens"])

        done: list[list] = []
        for batch in batches:
            for i, (key, fresh, rest) in enumerate(zip(batch.column("key").to_pylist(), read(batch), batch.column("rest").to_pylist(), strict=True)):
                if done and done[-1][0] == key:
                    machine = machine or machine_of(tokenizer)
                    done[-1][1] = machine.joined(done[-1][1], fresh)
                    done[-1][2] = machine.rest(machine.state(done[-1][1].tail))
                    continue
                if len(done) >= LOT:
                    yield full(done)
                    done = []
                done.append([key, fresh, rest, batch.column("row").slice(i, 1)])
        if done:
            yield full(done)

    key = [T.StructField("key", T.LongType()), T.StructField("block", T.IntegerType())]
    held = T.StructField("row", row)
    # numbers of partitions that are named stay: rows are few bytes and, in long texts, much work
    maps = chunks.mapInArrow(measure, T.StructType([*key, T.StructField("n", T.IntegerType()), *_MAP, held]))
    blocks = maps.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "n").mapInArrow(reduce_blocks, T.StructType([*key, T.StructField("rest", T.LongType()), *_MAP, held]))
    whole = blocks.repartition(parts, "key").sortWithinPartitions("key", "block").mapInArrow(reduce_documents, T.StructType([held, T.StructField("n_tokens", T.LongType())]))
    return whole.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "n_tokens")


def counted_documents(docs: DataFrame, tokenizer_file: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``.

    A null text counts as empty: no bytes, no tokens. Null and repeated doc_ids and repeated rows stay as they are. An empty table
    gives no rows; further columns are ignored.
    """
    rows = docs.select("doc_id", "text").withColumn("n_bytes", F.octet_length(text_of("text")).cast("long"))
    return with_token_counts(rows, tokenizer_file).withColumn("over_limit", F.col("n_tokens") > limit)
