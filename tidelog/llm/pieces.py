"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is a path through the lattice of pieces. At a chunk's border the path's state is
(how many characters the last piece reaches over, the last piece), or START where the
border is a place that no piece spans. A chunk's transfer matrix has, for each state it
can be entered in, the best weight of a path to each state it can be left in; matrices
combine by (max, +), which is associative. A document's chunks are dealt over all tasks,
their matrices combined in a tree of FAN at a time; down the same tree the state at every
border follows, and each chunk is then traced back by itself, over all tasks again.

Unigram models weigh pieces by their scores. For BPE models the weights are 0 and
minus infinity: a sequence of pieces is the BPE encoding just when every two neighbours,
merged anew, stay as they are, so the one path of weight 0 is what the merges give.
At a place that no piece spans (before a blank, round a line feed if no piece holds one)
the matrix has a single row or column. A lattice is built from each border to the first
such place in the chunk and from the last one on, or through the whole chunk where there
is none; the fragments between such places are encoded once and remembered.

Texts of at most two chunks are encoded at once. A null text is an empty one and gives
no ids. Decoding turns the mark for blanks into blanks, so a text that itself has that
mark (U+2581) comes back with a blank there; any other text comes back as it was.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import math
import pickle
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_parts, tidied, written

CHUNK = 1 << 13
#: Chunks, or groups of them, whose matrices one step of the tree combines.
FAN = 64
#: Stands for a blank in models' pieces.
MARK = "▁"
MOST_FRAGMENTS, LONG_FRAGMENT = 600_000, 48
START = -1
#: Model types that the lattice covers.
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_model(path: str) -> tuple[bytes, int]:
    """The model's bytes and its type."""
    from sentencepiece import sentencepiece_model_pb2

    data = open(path, "rb").read()
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(data)
    kind = int(model.trainer_spec.model_type)
    if kind not in (UNIGRAM, BPE) or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only unigram and BPE models without normalisation are supported")
    return data, kind


class Known(dict):
    """Ids of each fragment seen; forgets the older half when it grows too large."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def make_room(self, new: int) -> None:
        if len(self) + new > MOST_FRAGMENTS:
            kept = list(itertools.islice(self.items(), len(self) // 2, None))[-max(0, MOST_FRAGMENTS - new) :]
            self.clear()
            self.update(kept)

    def __missing__(self, fragment: str) -> bytes:
        ids = self.pieces.ids_of(fragment)
        if len(fragment) <= LONG_FRAGMENT:
            self.make_room(1)
            self[fragment] = ids
        return ids


class Pieces:
    """A model's pieces, the lattice over them and a memory of fragments."""

    def __init__(self, model: bytes, kind: int):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i).replace(MARK, " "): i for i in usable}
        self.score = {i: sp.get_score(i) for i in usable}
        self.unknown_score = min(self.score.values(), default=0.0) - 10
        self.kind, self.longest = kind, max(map(len, self.ids), default=1)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(sp.is_byte(i) for i in self.bytes)
        self.feed = not any("\n" in p for p in self.ids) and kind == BPE and self.fallback
        self.table = [b"\xef\xbf\xbd"] * n
        for p, i in self.ids.items():
            self.table[i] = p.encode()
        for i in range(n):
            if sp.is_control(i):
                self.table[i] = b""
        if self.fallback:
            for b, i in enumerate(self.bytes):
                self.table[i] = bytes([b])
        self.inner = any(re.search("[^ ] ", p) for p in self.ids)
        pairs = self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Signs that no piece has right behind a letter: a run of letters before one is a fragment.
        signs = re.escape("".join(c for c in string.punctuation if self.feed and not any(b == c and a.isalpha() for a, b in pairs)))
        words = rf"\n| *[^\W\d_]+(?=[ \n{signs}]|\Z)| *[^ \n]+| +" if self.feed else " *[^ ]+| +"
        self.fragments = re.compile("(?s).+" if self.inner else words)
        self.known = Known(self)
        self.joined: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.names = {i: p for p, i in self.ids.items()}

    # Whole fragments

    def ids_of(self, fragment: str) -> bytes:
        if self.feed:  # behind a line feed there is no blank put in front
            return np.array(self.sp.encode("\n" + fragment)[2:], np.int32).tobytes()
        return np.array(self.tokens_to_ids(self.trace(fragment, 0, len(fragment), (0, START), (0, START))), np.int32).tobytes()

    def remember(self, fragments: set[str]) -> None:
        """Encodes new fragments in few calls, each behind a line feed, which no piece joins and no blank is put behind."""
        new = [f for f in fragments.difference(self.known) if len(f) <= LONG_FRAGMENT and f != "\n"] if self.feed else []
        new = new[: MOST_FRAGMENTS // 2]
        self.known.make_room(len(new))
        if new:
            for first in range(0, len(new), 50_000):
                part = new[first : first + 50_000]
                found = self.sp.encode(["\n" + f for f in part], num_threads=1)
                self.known.update((f, array.array("i", ids[2:]).tobytes()) for f, ids in zip(part, found))

    def encode_all(self, marked: list[str]) -> list[bytes]:
        """encode() of many texts, whose new fragments are encoded together."""
        cut = [self.fragments.findall(t) for t in marked]
        self.remember(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, fragments)) for fragments in cut]

    def encode(self, marked: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.fragments.findall(marked)))

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.table.__getitem__, np.frombuffer(ids, np.int32).tolist()))
        return data.removeprefix(b" ").decode(errors="replace")

    # The lattice

    def border(self, text: str, p: int) -> bool:
        """Whether no piece spans the place before text[p]."""
        if p == 0 or p == len(text):
            return True
        return text[p - 1 : p + 1] not in self.pairs

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best = max(((self.score[self.ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ids), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def name(self, token: int) -> str:
        return self.names[token] if token >= 0 else chr(-2 - token)

    def stays(self, token: int) -> bool:
        """Whether the piece's own characters encode to it."""
        if token < 0 or self.kind == UNIGRAM:
            return True
        got = self.alone.get(token)
        if got is None:
            got = self.alone[token] = self.merged(self.name(token)) == [self.name(token)]
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: both, merged anew, stay as they are."""
        if a < 0 or b < 0 or self.kind == UNIGRAM:
            return True
        got = self.joined.get((a, b))
        if got is None:
            if len(self.joined) >= MOST_FRAGMENTS:
                self.joined.clear()
            x, y = self.name(a), self.name(b)
            got = self.joined[a, b] = self.merged(x + y) == [x, y]
        return got

    def starting(self, text: str, p: int) -> Iterator[tuple[int, int, float]]:
        """(token, end, weight) of each piece that begins at p; a character without a piece is a token of its own."""
        for end in range(p + 1, min(len(text), p + self.longest) + 1):
            token = self.ids.get(text[p:end])
            if token is not None and self.stays(token):
                yield token, end, self.score[token] if self.kind == UNIGRAM else 0.0
        if text[p] not in self.ids:
            yield -2 - ord(text[p]), p + 1, self.unknown_score if self.kind == UNIGRAM else 0.0

    def state(self, text: str, border: int, end: int, token: int) -> tuple[int, int]:
        return end - border, START if self.kind == UNIGRAM or self.border(text, end) else token

    def entries(self, text: str, p: int) -> list[tuple[int, int]]:
        """States in which p can be passed."""
        if self.border(text, p):
            return [(0, START)]
        out = {self.state(text, p, end, token) for s in range(max(0, p - self.longest), p) for token, end, _ in self.starting(text, s) if end >= p}
        return sorted(out)

    def paths(self, text: str, low: int, high: int, entries: list[tuple[int, int]]):
        """Nodes (place, token) of the lattice from low on, each with its best weight from every entry and where it came from."""
        nodes: dict[int, dict[int, tuple[np.ndarray, list]]] = {}

        def put(p, token, weight, back):
            here = nodes.setdefault(p, {})
            if token in here:
                old, source = here[token]
                better = weight > old
                here[token] = np.where(better, weight, old), [b if x else s for x, b, s in zip(better, back, source)]
            else:
                here[token] = weight, back

        for i, (over, token) in enumerate(entries):
            unit = np.full(len(entries), -math.inf)
            unit[i] = 0.0
            put(low + over, token, unit, [None] * len(entries))
        for p in range(low, high):
            if p not in nodes:
                continue
            here = list(nodes[p].items())
            for token, end, w in self.starting(text, p):
                for last, (weight, _) in here:
                    if self.fits(last, token):
                        put(end, self.state(text, end, end, token)[1], weight + w, [(p, last, token)] * len(entries))
        return nodes

    def leave(self, text: str, low: int, high: int, entries) -> dict[tuple[int, int], np.ndarray]:
        nodes = self.paths(text, low, high, entries)
        return {(p - high, token): weight for p in nodes if p >= high for token, (weight, _) in nodes[p].items()}

    def trace(self, text: str, low: int, high: int, entry, exit_) -> list[int]:
        nodes, out = self.paths(text, low, high, [entry]), []
        p, token = high + exit_[0], exit_[1]
        while (back := nodes[p][token][1][0]) is not None:
            p, token, piece = back
            out.append(piece)
        return out[::-1]

    def tokens_to_ids(self, tokens: list[int]) -> list[int]:
        return [i for t in tokens for i in ([t] if t >= 0 else [self.bytes[b] for b in chr(-2 - t).encode()] if self.fallback else [self.sp.unk_id()])]

    # Chunks: text has a margin of `longest` characters on either side of low to high

    def inner_borders(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last place from low to high that no piece spans."""
        first = next((p for p in range(low, high + 1) if self.border(text, p)), None)
        if first is None:
            return None
        return first, next(p for p in range(high, low - 1, -1) if self.border(text, p))

    def transfer(self, text: str, low: int, high: int) -> dict[tuple, dict[tuple, float]]:
        """The chunk's matrix."""
        entries, inner = self.entries(text, low), self.inner_borders(text, low, high)
        if inner is None:
            out = self.leave(text, low, high, entries)
            return {e: {x: float(w[i]) for x, w in out.items() if w[i] > -math.inf} for i, e in enumerate(entries)}
        first, last = inner
        head = self.leave(text, low, first, entries).get((0, START), np.full(len(entries), -math.inf)) if first > low else np.zeros(len(entries))
        middle = self.weight(text[first:last])
        tail = self.leave(text, last, high, [(0, START)]) if last < high else {(0, START): np.zeros(1)}
        return {e: {x: float(head[i] + middle + w[0]) for x, w in tail.items() if w[0] > -math.inf} for i, e in enumerate(entries) if head[i] > -math.inf}

    def weight(self, marked: str) -> float:
        if self.kind == BPE:
            return 0.0
        return sum(self.score.get(i, self.unknown_score) for i in np.frombuffer(self.encode(marked), np.int32).tolist())

    def chunk_ids(self, text: str, low: int, high: int, entry, exit_) -> bytes:
        """The ids of the pieces that begin in the chunk."""
        pack = lambda tokens: np.array(self.tokens_to_ids(tokens), np.int32).tobytes()
        inner = self.inner_borders(text, low, high)
        if inner is None:
            return pack(self.trace(text, low, high, entry, exit_))
        first, last = inner
        head = pack(self.trace(text, low, first, entry, (0, START))) if first > low else b""
        tail = pack(self.trace(text, last, high, (0, START), exit_)) if last < high else b""
        return head + self.encode(text[first:last]) + tail


def combine(a: dict, b: dict) -> dict:
    """The max-plus product of two transfer matrices."""
    out: dict[tuple, dict[tuple, float]] = {}
    for entry, row in a.items():
        new = out.setdefault(entry, {})
        for mid, w in row.items():
            for x, v in b.get(mid, {}).items():
                if w + v > new.get(x, -math.inf):
                    new[x] = w + v
    return out


def product(matrices: list[dict]) -> dict:
    """Neighbours combined, and their products again, up to one matrix."""
    while len(matrices) > 1:
        matrices = [combine(*pair) if len(pair) == 2 else pair[0] for pair in (matrices[i : i + 2] for i in range(0, len(matrices), 2))]
    return matrices[0]


def border_states(matrices: list[dict], entry: tuple[int, int] = (0, START), exit_: tuple[int, int] = (0, START)) -> list[tuple[int, int]]:
    """The state at each border of some neighbouring chunks, the outer two given."""
    rows = [{entry: 0.0}]
    for m in matrices[:-1]:
        rows.append(combine({0: rows[-1]}, m)[0])
    states = [exit_]
    for m, row in zip(reversed(matrices), reversed(rows)):
        states.append(max((w + m[s][states[-1]], s) for s, w in row.items() if states[-1] in m.get(s, {}))[1])
    return states[::-1]


def marked_text(text: str) -> str:
    """The text as models see it: a blank in front, the mark for blanks the same as one."""
    return " " + text.replace(MARK, " ") if text else ""


OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
DDL = "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_sha256, decoded_sha256) of each row, and ids as an array unless with_ids is off.

    ids_sha256 is that of the ids as little-endian 32-bit integers, decoded_sha256 that of what decoding them gives.
    """
    loaded = load_model(model or default_model())
    sent = docs.sparkSession.sparkContext.broadcast((*loaded, Pieces(*loaded).longest))
    schema = pa.schema(OUT + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    ddl = DDL + (", ids array<int>" if with_ids else "")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def rows(found: list[tuple[int | None, int, bytes]], pieces: Pieces) -> pa.RecordBatch:
        out = [(doc, n, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()) for doc, n, ids in found]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)]
        if with_ids:
            ends = np.cumsum([0] + [len(ids) // 4 for _, _, ids in found]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids for _, _, ids in found), np.int32))))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def whole(batches):
        pieces = Pieces(*sent.value[:2])
        for part in row_parts(batches, "text", 2 << 20):
            texts = part.column("text").to_pylist()
            yield rows(list(zip(part.column("doc_id").to_pylist(), map(len, texts), pieces.encode_all([marked_text(t) for t in texts]))), pieces)

    parts = pa.schema([("uid", pa.int64()), ("no", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
    parts_ddl = "uid long, no long, doc_id long, n_chars long, text string, low long, high long"

    def chunks(batches):
        """Each text cut, with what its neighbours' pieces may reach over; no piece is looked up here."""
        number, margin = TaskContext.get().partitionId() << 33, sent.value[2]
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                number, text = number + 1, marked_text(t)
                for first in range(0, len(text), 64 * chunk):
                    rows = []
                    for at in range(first, min(len(text), first + 64 * chunk), chunk):
                        begin, end = max(0, at - margin), min(len(text), at + chunk)
                        rows.append((number, at // chunk, i, len(t), text[begin : end + margin], at - begin, end - begin))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), parts)], schema=parts)

    def transfers(batches):
        pieces = Pieces(*sent.value[:2])
        for b in batches:
            found = [pickle.dumps(pieces.transfer(*x)) for x in zip(*(b.column(c).to_pylist() for c in ("text", "low", "high")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, "matrix"])

    def grouped(batches, others):
        """Groups (uid, grp) of sorted rows: their numbers, matrices and other columns."""
        key, held = None, []
        for batch in batches:
            for u, g, *row in zip(*(batch.column(c).to_pylist() for c in ("uid", "grp", "no", "matrix", *others))):
                if (u, g) != key:
                    if held:
                        yield key, held
                    key, held = (u, g), []
                held.append(row)
        if held:
            yield key, held

    def up(batches):
        for (u, g), held in grouped(batches, ()):
            yield pa.RecordBatch.from_pydict({"uid": [u], "no": [g], "matrix": [pickle.dumps(product([pickle.loads(m) for _, m in held]))]})

    def down(batches):
        for (u, _), held in grouped(batches, ("entry", "exit")):
            at = border_states([pickle.loads(r[1]) for r in held], pickle.loads(held[0][2]), pickle.loads(held[0][3]))
            yield pa.RecordBatch.from_pydict({"uid": [u] * len(held), "no": [r[0] for r in held], "entry": [pickle.dumps(s) for s in at[:-1]], "exit": [pickle.dumps(s) for s in at[1:]]})

    def trace(batches):
        pieces = Pieces(*sent.value[:2])
        for batch in batches:
            got = [pieces.chunk_ids(t, lo, hi, pickle.loads(a), pickle.loads(b)) for t, lo, hi, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "low", "high", "entry", "exit")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "no", "doc_id", "n_chars")), pa.array(got, pa.binary())], names=["uid", "no", "doc_id", "n_chars", "ids"])

    def gather(batches):
        pieces, uid, held = Pieces(*sent.value[:2]), None, None
        for batch in batches:
            for u, i, n, ids in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "n_chars", "ids"))):
                if u != uid:
                    if held:
                        yield rows([(held[0], held[1], b"".join(held[2]))], pieces)
                    uid, held = u, (i, n, [])
                held[2].append(ids)
        if held:
            yield rows([(held[0], held[1], b"".join(held[2]))], pieces)

    small = own.where(F.length("text") <= 2 * chunk).mapInArrow(tidied(whole), ddl)
    cut = own.where(F.length("text") > 2 * chunk).mapInArrow(tidied(chunks), parts_ddl)
    giants = written(cut.repartition("uid", "no").mapInArrow(tidied(transfers), f"{parts_ddl}, matrix binary"), "chunks")
    in_groups = lambda rows: rows.repartition("uid", "grp").sortWithinPartitions("uid", "grp", "no")
    with_group = lambda rows: rows.withColumn("grp", F.floor(F.col("no") / FAN))
    levels, most = [giants.select("uid", "no", "matrix")], giants.agg(F.max("no")).first()[0] or 0
    while most:  # as many levels as the logarithm of the longest text's chunks
        levels.append(written(in_groups(with_group(levels[-1])).mapInArrow(tidied(up), "uid long, no long, matrix binary"), "level"))
        most //= FAN
    outer = F.lit(pickle.dumps((0, START)))
    states = levels.pop().select("uid", "no", outer.alias("entry"), outer.alias("exit"))
    for below in reversed(levels):
        above = states.withColumnRenamed("no", "grp")
        states = in_groups(with_group(below).join(above, ["uid", "grp"])).mapInArrow(tidied(down), "uid long, no long, entry binary, exit binary")
    traced = giants.drop("matrix").join(states, ["uid", "no"]).mapInArrow(tidied(trace), "uid long, no long, doc_id long, n_chars long, ids binary")
    return small.unionByName(traced.repartition("uid").sortWithinPartitions("uid", "no").mapInArrow(tidied(gather), ddl))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null array is an empty one."""
    sent = encoded.sparkSession.sparkContext.broadcast(load_model(model or default_model()))

    def texts(batches):
        pieces = Pieces(*sent.value)
        for b in batches:
            out = [pieces.decode(np.array(x or [], np.int32).tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidied(texts), "doc_id long, text string")


def op3(docs: DataFrame) -> DataFrame:
    """The digest of encode(): ids of each document and what decoding gives."""
    return encode(docs, with_ids=False)
