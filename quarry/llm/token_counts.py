"""Token counts by a compiled finite-state tokenizer.

Two deterministic machines count the tokens of a byte-level BPE vocabulary:

* the splitter, over character classes, which finds where words start, and
* the word machine. Its state after a prefix of a word holds, for each suffix of
  the prefix that a longer token could start with, that suffix, the last token
  before it and how many tokens come before it; a transition on a byte is
  annotated with the number of tokens it adds (fewer tokens may come out of a
  longer prefix, so the number can be negative). States are made when they are
  first reached and kept in a table of bounded size.

Long texts are read in chunks of fixed size, dealt over all tasks. A chunk's state
map takes the word machine's state before the chunk to the tokens that the chunk
adds and the state behind it. Where words start depends on a few characters only,
so a chunk, with ``LOOK`` bytes before it and a few behind it, finds its own word
starts; one start before it tells the state, and the map has one entry for all
states. In longer words (runs of one letter, prose without marks) the map has an
entry for each state that any place of those ``LOOK`` bytes leads to, started as a
word. Maps compose associatively: Spark composes ``FAN`` neighbours at a time, in as
many rounds as the longest possible text needs. A state that a map lacks leaves the
text without a count, and such texts are counted whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe
from quarry.llm.flat import flat, slices, strings
from quarry.session import cut, table

#: Bytes of a chunk; most documents are one chunk.
CHUNK = 1 << 15
#: Bytes before a chunk that it knows, bytes behind it, and maps that are composed at once.
LOOK, AHEAD, FAN = 256, 64, 64
#: Most bytes of a text.
TEXT_LIMIT = 1 << 31
#: States, pairs of tokens, words and moved states that a task keeps.
STATES, PAIRS, WORD_ENTRIES, MOVES = 150_000, 400_000, 300_000, 20_000
#: State at the start of a word, and the name of any state.
START, ANY = ((0, None, 0),), "*"
OTHER, LETTER, NUMBER, BLANK = range(4)
#: Fixed values of the splitting pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_loaded: dict[str, Machine] = {}


def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


class Machine:
    """The compiled tokenizer of one vocabulary file."""

    def __init__(self, path: str):
        spec, byte_of = bpe.file_spec(path), bpe.byte_of()
        words, special = bpe.ranks(path)
        self.special = [s.encode() for s in special]
        #: Bytes behind a cut within which word starts aren't sure: the rest of a special string, a contraction, its neighbours.
        self.guard = max(map(len, self.special), default=0) + 20
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {tuple(bytes(byte_of[c] for c in part) for part in m): r for r, m in enumerate(merges)}
        # A trie of the tokens: child nodes by (node, byte), the token that ends at a node, nodes that tokens go on from.
        self.child: dict[int, int] = {}
        self.token: dict[int, bytes] = {}
        self.inner: set[int] = set()
        nodes = 1
        for w in words:
            at = 0
            for b in w:
                self.inner.add(at)
                if (key := at << 8 | b) not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                at = self.child[key]
            self.token[at] = w
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        self.classes = char_classes()
        self.words: dict[bytes, int] = {}
        self.moves: dict[tuple[tuple, bytes], tuple[int, tuple]] = {}
        self.reset()

    def reset(self) -> None:
        self.states, self.configs, self.step = {START: 0}, [START], {}

    def merged(self, word: bytes) -> list[bytes]:
        """Tokens of a short word, merging by rank."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (pair := (parts[best], parts[best + 1])) not in self.rank:
                break
            parts[best : best + 2] = [pair[0] + pair[1]]
        return parts

    def follows(self, before: bytes | None, token: bytes) -> bool:
        """Do the two tokens stay as they are, side by side? A tokenization is one of which all neighbours do."""
        if (key := (before, token)) not in self.pairs:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[key] = self.merged((before or b"") + token) == ([before, token] if before is not None else [token])
        return self.pairs[key]

    def transition(self, state: int, byte: int) -> int:
        """Next state << 12 | added tokens + 2048, determinized when first asked for."""
        config, moved, last, cost = self.configs[state], [], None, 0
        for node, before, rest in config:
            if (at := self.child.get(node << 8 | byte)) is None:
                continue
            if last is None and (token := self.token.get(at)) is not None and self.follows(before, token):
                last, cost = token, rest + 1
            if at in self.inner:
                moved.append((at, before, rest))
        after = (*((at, before, rest - cost) for at, before, rest in moved), (0, last, 0))
        to = self.states.get(after)
        if to is None:
            to = self.states[after] = len(self.configs)
            self.configs.append(after)
        out = self.step[state << 8 | byte] = to << 12 | cost + 2048
        return out

    def number(self, config: tuple) -> int:
        state = self.states.setdefault(config, len(self.configs))
        if state == len(self.configs):
            self.configs.append(config)
        return state

    def moved(self, config: tuple, text: bytes) -> tuple[int, tuple]:
        """Tokens that bytes of one word add, and the state behind them."""
        step, state, n = self.step, self.number(config), 0
        for b in text:
            to = step.get(state << 8 | b)
            if to is None:
                if len(self.configs) > STATES:  # a long word goes on from where it is, in new tables
                    config = self.configs[state]
                    self.reset()
                    step, state = self.step, self.number(config)
                to = self.transition(state, b)
            state = to >> 12
            n += (to & 4095) - 2048
        return n, self.configs[state]

    def count(self, word: bytes) -> int:
        """Tokens of one word of the splitter, or of a special token."""
        return 1 if word in self.special else self.moved(START, word)[0]

    def moved_all(self, configs: list[tuple], text: bytes) -> dict[tuple, tuple[int, tuple]]:
        """``moved`` for several states, in blocks, at whose ends states that have become one go on as one."""
        now = {c: (0, c) for c in configs}
        for a in range(0, len(text), 128):
            block, to = text[a : a + 128], {}
            for config in {c for _, c in now.values()}:
                if (got := self.moves.get((config, block))) is None:
                    if len(self.moves) > MOVES:
                        self.moves.clear()
                    got = self.moves[config, block] = self.moved(config, block)
                to[config] = got
            now = {c: (n + to[at][0], to[at][1]) for c, (n, at) in now.items()}
        return now

    def word_starts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte positions at which the splitter begins a word; ``off`` bounds the texts."""
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        first = buf[lead]
        if (first < 128).all():
            kind = self.classes[first]
        else:
            code, wide = first.astype(np.int64), first >= 0xC0
            at, size = lead[wide], 2 + (first[wide] >= 0xE0).astype(np.int64) + (first[wide] >= 0xF0)
            value = first[wide].astype(np.int64) & (0xFF >> (size + 1))
            for k in (1, 2, 3):
                more = size > k
                value[more] = value[more] << 6 | (buf[np.minimum(at[more] + k, len(buf) - 1)] & 0x3F)
            code[wide] = np.minimum(value, 0x10FFFF)  # a character that a cut parts can be any
            kind = self.classes[code]
        n = len(lead)
        new = np.zeros(n + 1, bool)
        new[np.searchsorted(lead, off)] = True
        new = new[:n]
        before, is_blank = np.empty_like(kind), kind == BLANK
        before[0], before[1:] = BLANK, kind[:-1]
        before[new] = OTHER
        after_blank = (before == BLANK) & ~new
        ends = np.ones(n, bool)  # the last character of a white space run that something follows
        ends[:-1] = ~is_blank[1:] & ~new[1:]
        ends[-1] = False
        plain = np.zeros(n, bool)
        plain[1:] = first[:-1] == 32
        start = np.where(is_blank, ~after_blank | ends, np.where(after_blank, ~plain, kind != before)) | new
        quote = np.flatnonzero((first == 39) & start)
        quote = quote[new[quote] | (before[quote] != OTHER)]
        if len(quote):
            edge = np.append(lead, len(buf))
            bound = np.append(np.flatnonzero(new), n)
            stop = bound[np.searchsorted(bound, quote, side="right")]
            for i, e in zip(quote.tolist(), stop.tolist(), strict=True):
                tail = buf[edge[i] + 1 : edge[min(i + 3, e)]].tobytes()
                size = next((len(c) for c in CONTRACTIONS if tail.startswith(c.encode())), 0)
                if size:
                    start[i + 1 : i + 1 + size] = False
                    if i + 1 + size < e:
                        start[i + 1 + size] = True
        return lead[start]

    def split(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Where words and special tokens start, and which of these are special."""
        cuts = [off]
        raw = buf.tobytes()
        for s in self.special:  # these strings are tokens wherever they stand, and texts end at them
            at = raw.find(s)
            while at >= 0:
                if np.searchsorted(off, at, side="right") == np.searchsorted(off, at + len(s), side="left"):
                    cuts.append(np.array([at, at + len(s)]))
                    at += len(s) - 1
                at = raw.find(s, at + 1)
        specials = {int(c[0]) for c in cuts[1:]}
        starts = self.word_starts(buf, np.unique(np.concatenate(cuts)))
        if specials:
            inside = np.zeros(len(buf) + 1, bool)
            for c in cuts[1:]:
                inside[c[0] + 1 : c[1]] = True
            starts = starts[~inside[starts]]
        return starts, specials

    def each(self, buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Tokens of the words between neighbouring edges."""
        coded = strings(buf, edges).dictionary_encode()
        if len(self.words) > WORD_ENTRIES:
            self.words.clear()
        known, each = self.words, []
        for w in coded.dictionary.to_pylist():
            n = known.get(w)
            if n is None:
                n = known[w] = self.count(w)
            each.append(n)
        return np.array(each, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def counts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text that ``off`` bounds."""
        if not len(buf):
            return np.zeros(len(off) - 1, np.int64)
        starts = self.split(buf, off)[0]
        total = np.concatenate(([0], np.cumsum(self.each(buf, np.append(starts, len(buf))))))
        at = total[np.searchsorted(starts, off)]
        return at[1:] - at[:-1]

    def state_map(self, text: bytes, at: int, skip: int, size: int, look: int = LOOK) -> dict[str, tuple[int, str]]:
        """Tokens and state behind a chunk, by the state before it.

        The chunk is ``size`` bytes from place ``at`` of its document; ``text`` is
        these, ``skip`` bytes before them, and some behind them.
        """
        buf, stop = np.frombuffer(text, np.uint8), skip + size
        starts, specials = self.split(buf, np.array([0, len(text)]))
        starts = starts[starts >= (self.guard if at > skip else 0)]
        lo, hi = int(np.searchsorted(starts, skip, side="right")), int(np.searchsorted(starts, stop))

        def piece(word: int, a: int, b: int) -> tuple[int, tuple]:
            """The part from a to b of the word that starts at ``word``; a special token counts where it starts."""
            if word in specials:
                return int(a == word), START
            return self.moved(self.moved(START, text[word:a])[1], text[a:b])

        first = int(starts[lo]) if lo < hi else stop
        if lo:
            found = {ANY: piece(int(starts[lo - 1]), skip, first)}
        else:
            before = {self.moved(START, text[p:skip])[1] for p in range(skip)}
            found = {named(c): to for c, to in self.moved_all(list(before), text[skip:first]).items()}
        if lo < hi:
            last = int(starts[hi - 1])
            more, behind = piece(last, last, stop)
            more += int(self.each(buf, starts[lo:hi]).sum()) if hi - lo > 1 else 0
            found = {k: (n + more, behind) for k, (n, _) in found.items()}
        # The next chunk asks for the state before it if it sees no word start.
        sees = max(0, at + size - look)
        sure = sees - (at - skip) + (self.guard if sees else 0)
        asks = np.searchsorted(starts, sure) == np.searchsorted(starts, stop, side="right")
        return {k: (n, named(c) if asks else ANY) for k, (n, c) in found.items()}


def named(config: tuple) -> str:
    """Short name of a state, the same in all tasks."""
    return hashlib.md5(repr(config).encode()).hexdigest()


def machine(path: str) -> Machine:
    if path not in _loaded:
        _loaded[path] = Machine(path)
    return _loaded[path]


def composed(maps: list[dict[str, tuple[int | None, str]]]) -> dict[str, tuple[int | None, str]]:
    """State map of neighbouring spans; no count where a span's map lacks a state."""
    out = maps[0]
    for after in maps[1:]:
        all_alike = after.get(ANY)
        pairs = {k: (n, all_alike or after.get(state, (None, ANY))) for k, (n, state) in out.items()}
        out = {k: (None if n is None or more is None else n + more, to) for k, (n, (more, to)) in pairs.items()}
    return out


def token_counts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK, look: int = LOOK) -> DataFrame:
    """id, n_bytes and n_tokens of each row; null and empty texts have none of either.

    Rows are kept apart even where ids repeat or are null. Texts of over ``chunk``
    bytes are counted as chunks, dealt over all tasks, that meet as state maps only.
    Other columns aren't read, whatever their names.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("_id"), F.encode(text, "UTF-8").alias("_bytes"))
    schema = f"_id {kind}, n_bytes bigint, n_tokens bigint"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in slices(batches, "_bytes"):
            buf, off = flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(m.counts(buf, off))], ["_id", "n_bytes", "n_tokens"])

    size = F.octet_length("_bytes")
    short = rows.where(size <= chunk).mapInArrow(whole, schema)
    long = rows.where(size > chunk).withColumn("_hash", F.md5("_bytes"))
    totals = cut(_by_chunks(long, path, kind, chunk, look))
    out = short.union(totals.where("n_tokens IS NOT NULL").select("_id", "n_bytes", "n_tokens"))
    lost = totals.where("n_tokens IS NULL").select("_hash")  # equal texts are lost or counted together
    if not lost.isEmpty():
        out = out.union(long.join(lost, "_hash", "left_semi").select("_id", "_bytes").mapInArrow(whole, schema))
    return out.withColumnRenamed("_id", id_column)


def _by_chunks(long: DataFrame, path: str, kind: str, chunk: int, look: int) -> DataFrame:
    """_id, _hash, n_bytes and n_tokens (null: a map lacks a state) of texts in chunks."""
    size = F.octet_length("_bytes")
    cuts = long.withColumn("_row", F.monotonically_increasing_id()).withColumn("_at", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int"))))
    at = F.col("_at") * chunk
    skip = F.least(at, F.lit(look))
    own = F.least(F.lit(chunk), size - at)
    parts = cuts.select("_id", "_hash", "_row", "_at", skip.alias("_skip"), own.alias("_size"), F.col("_bytes").substr(at - skip + 1, skip + chunk + AHEAD).alias("_text")).repartition("_row", "_at")
    fields = ["_id", "_hash", "_row", "_at", "n_bytes", "states", "adds", "leads"]
    schema = f"_id {kind}, _hash string, _row bigint, _at int, n_bytes bigint, states array<string>, adds array<bigint>, leads array<string>"

    def packed(columns: list[pa.Array], maps: list[dict]) -> pa.RecordBatch:
        lists = [pa.array([list(m) for m in maps], pa.list_(pa.string())), pa.array([[n for n, _ in m.values()] for m in maps], pa.list_(pa.int64())), pa.array([[to for _, to in m.values()] for m in maps], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *lists], fields)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in slices(batches, "_text"):
            some = zip(*(batch.column(i).to_pylist() for i in (6, 3, 4, 5)), strict=True)
            got = [m.state_map(t, k * chunk, s, n, look) for t, k, s, n in some]
            yield packed([*(batch.column(i) for i in range(4)), batch.column(5).cast(pa.int64())], got)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [composed([{k: (n, to) for k, n, to in zip(p["states"], p["adds"], p["leads"], strict=True)} for p in group]) for group in batch.column(5).to_pylist()]
            yield packed([batch.column(i) for i in range(5)], got)

    out, most = parts.mapInArrow(maps, schema), -(-TEXT_LIMIT // chunk)
    while most > 1:
        span = F.struct("_at", "states", "adds", "leads")
        by = out.groupBy("_row", F.floor(F.col("_at") / FAN).cast("int").alias("_to")).agg(F.first("_id").alias("_id"), F.first("_hash").alias("_hash"), F.sum("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(span)).alias("_spans"))
        out, most = by.select("_id", "_hash", "_row", F.col("_to").alias("_at"), "n_bytes", "_spans").mapInArrow(together, schema), -(-most // FAN)
    return out.select("_id", "_hash", "n_bytes", F.get("adds", F.lit(0)).alias("n_tokens"))  # a text's first chunk has one entry


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and whether they exceed 512."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit")
    )
