"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often in the corpus.

A is a byte-level BPE file read with a space before each text, B a sentencepiece BPE model that puts that space itself.
Each Arrow batch is aligned with Arrow's own operations: token lists are flattened, parent indices name their documents,
running sums of token lengths within a document give byte ends, and a hash join on (document, end) finds the ends that A
and B share. They cut both token sequences into groups; a second hash join on the group gives the links, all pairs of an
A and a B token of one group. Groups of many pairs are joined by distinct ids with their numbers, so that no group is
expanded pair by pair. Table.group_by counts the documents that hold a pair, in parts that Spark sums over the corpus.
The counts are broadcast if they are few enough, else joined by shuffle, and each document sums those of its links.

Token lists come from the tokenizers' libraries. Both tokenizers work apart on both sides of the cuts made here: before the
first of a run of spaces, before a space between a text and a graphic ASCII character, and around single line ends between
graphic ASCII characters (`cuts`; for B, no token has a space or a line end after another character, which is checked). So a
batch is encoded by its distinct pieces, and pieces are remembered by a worker up to a bound.

Defined results: null and empty texts have zeros and an empty digest, as have texts that a tokenizer doesn't give back byte
by byte (U+2581 is one such for B); special tokens' strings are plain text; rows that share a doc_id are documents of their
own, also in counts; extra columns are not read."""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import textnp as tx
from larkspur.llm.bpe import byte_alphabet, distinct_spans, gathered
from larkspur.llm.common import written

#: Counts of so many pairs (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 4_000_000
#: Pieces to a generation of what a worker remembers; a longer piece is encoded at each occurrence.
REMEMBERED, LONG = 1 << 17, 200
DIFFERENT = array("i", [-1]).tobytes()
#: A group of more pairs is joined by distinct ids.
DENSE = 64
#: Rows of partial counts that a task holds before it passes them on.
PARTIAL = 1 << 20
#: Bytes of text aligned together.
SLICE = 1 << 20
META, BREAK = "▁", "\n"
#: Bytes of an id pair in one number: A above, B below.
SHIFT = 32

GRAPHIC = np.zeros(256, bool)
GRAPHIC[0x21:0x7F] = True


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The borders of texts and the byte positions inside them between which both tokenizers work apart, in order."""
    if len(data) < 3:
        return np.unique(offs)
    graphic, space, line = GRAPHIC[data], data == 0x20, data == 0x0A
    before, here, after = slice(0, -2), slice(1, -1), slice(2, None)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-2] = (space[here] & (graphic[before] | (data[before] >= 0x80) & graphic[after])) | (line[here] & graphic[before])
    cut[2:-1] |= line[here] & graphic[before] & graphic[after]
    # The position after a text's first byte or at its end has neighbours of one text only if it isn't a border itself.
    cut[offs] = False
    inner = offs[1:-1]
    near = np.concatenate([inner - 1, inner + 1])
    cut[near[(near > 0) & (near < len(data))]] = False
    cut[offs] = True
    return np.flatnonzero(cut)


class Pair:
    """Both tokenizers, with what a worker remembers of them: piece to 32-bit numbers, how many ids of A there are, these and the
    ids of B; -1 alone where bytes differ."""

    def __init__(self, spec: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = json.loads(spec)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in t)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(META in x.lstrip(META) or BREAK in x for x in names):
            raise ValueError("a piece of B crosses a cut")
        self.bytes_b = [bytes([int(x[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else x.replace(META, " ").encode() for i, x in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        if min(map(len, self.bytes_a)) < 1 or len({x for x in self.bytes_a if len(x) == 1}) < 256:
            raise ValueError("A has no token for some byte")
        self.raw_b = pa.array(self.bytes_b, pa.large_binary())
        # Two generations: what isn't met while the younger one fills up is forgotten.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # What B makes of a line end at the beginning: the space it adds, and the line end.
        self.lead = len(self.b.encode(BREAK))

    def fresh(self, pieces: list[str]) -> list[bytes]:
        """A gives every byte back, since it has a token for each; B's bytes are compared, all pieces at once."""
        of_a = [array("i", x.ids) for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        of_b = [array("i", x[self.lead :]) for x in self.b.encode([BREAK + x for x in pieces], num_threads=1)]
        whole = [x.encode() for x in pieces]
        ids = np.frombuffer(b"".join(of_b), np.int32)
        last = np.cumsum(np.fromiter(map(len, of_b), np.int64, len(of_b)))
        total = np.concatenate([[0], np.cumsum(self.size_b[ids])])[np.concatenate([[0], last])]
        same = np.diff(total) == np.fromiter(map(len, whole), np.int64, len(whole))
        if same.all():
            given = np.frombuffer(pc.take(self.raw_b, pa.array(ids)).buffers()[2] or b"", np.uint8)
            differ = np.flatnonzero(given != np.frombuffer(b"".join(whole), np.uint8))
            same[np.searchsorted(total, differ, "right") - 1] = False
        else:
            same = [b"".join(map(self.bytes_b.__getitem__, x)) == y for x, y in zip(of_b, whole, strict=True)]
        return [array("i", [len(x)]).tobytes() + x.tobytes() + y.tobytes() if ok else DIFFERENT for x, y, ok in zip(of_a, of_b, same, strict=True)]

    def encode(self, pieces: list[str]) -> list[bytes]:
        """pieces: distinct."""
        known, before = self.known, self.before
        out = [known.get(x) or before.get(x) for x in pieces]
        new = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(new, self.fresh([pieces[i] for i in new]) if new else (), strict=True):
            out[i] = x
        if len(known) + len(pieces) > REMEMBERED:
            self.known, self.before = {}, known
        self.known.update((x, y) for x, y in zip(pieces, out, strict=True) if len(x) <= LONG and y is not DIFFERENT)
        return out

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
        """Lists of ids of A and of B of each text (bytes with the space in front); both empty where bytes differ."""
        n = len(offs) - 1
        bounds = cuts(data, offs)
        texts, codes = distinct_spans(data, bounds[:-1], bounds[1:])
        made = self.encode(texts.to_pylist())
        row = np.searchsorted(offs, bounds[:-1], "right") - 1
        flat = np.frombuffer(b"".join(made), np.int32)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        first = np.cumsum(sizes) - sizes
        n_a = flat[first].astype(np.int64)
        keep = np.ones(n, bool)
        keep[row[(n_a < 0)[codes]]] = False
        inside = keep[row]
        codes, row = codes[inside], row[inside]
        out = []
        for size, begin in ((n_a, first + 1), (sizes - 1 - n_a, first + 1 + n_a)):
            values, taken = gathered(codes, flat, size, begin)
            counts = np.bincount(row, taken, n).astype(np.int64)
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values)))
        return out[0], out[1]


def _ends(lists: pa.ListArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, document, byte end within the document) of all tokens."""
    ids, parent = pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes[ids])
    begin = np.concatenate([[0], total])[lists.offsets.to_numpy()[:-1]]
    return ids, parent, total - begin[parent]


def _digests(parts: pa.Array, bounds: np.ndarray) -> list[str]:
    """SHA-256 of parts[bounds[i]:bounds[i + 1]], joined; the empty string where there are none."""
    _, offs, data = parts.buffers()
    at = np.frombuffer(offs, np.int64)[bounds].tolist()
    raw = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(raw[a:b]).hexdigest() if b > a else "" for a, b in zip(at[:-1], at[1:], strict=True)]


def _strings(n: int) -> pa.Array:
    """Ids followed by a comma, then by a bar, then by a semicolon, then by nothing."""
    return pa.array([f"{i}{end}" for end in ",|;" for i in range(n)] + [str(i) for i in range(n)], pa.large_string())


class Aligner:
    def __init__(self, spec: str, model: bytes):
        self.pair = Pair(spec, model)
        self.n = max(len(self.pair.bytes_a), len(self.pair.bytes_b))
        self.strings = _strings(self.n)

    def align(self, data: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
        """Columns of each text of a slice."""
        n = len(offs) - 1
        of_a, of_b = self.pair.tokens(data, offs)
        ids_a, doc_a, end_a = _ends(of_a, self.pair.size_a)
        ids_b, doc_b, end_b = _ends(of_b, self.pair.size_b)
        key = lambda doc, end: pa.array(doc.astype(np.int64) << 32 | end)
        left = pa.table({"key": key(doc_a, end_a), "a": np.arange(len(ids_a))})
        shared = left.join(pa.table({"key": key(doc_b, end_b), "b": np.arange(len(ids_b))}), "key", join_type="inner", use_threads=False)
        group_a, last_a = self._groups(shared["a"].to_numpy(), len(ids_a))
        group_b, last_b = self._groups(shared["b"].to_numpy(), len(ids_b))
        n_groups = shared.num_rows
        doc_of = doc_a[np.flatnonzero(last_a)]
        links = self._links(ids_a, group_a, ids_b, group_b, n_groups, doc_of)
        by_doc = np.argsort(links["doc"].to_numpy(), kind="stable")
        pairs, times = links["pair"].to_numpy()[by_doc], links["n"].to_numpy()[by_doc]
        held = np.bincount(links["doc"].to_numpy(), minlength=n)
        bounds = np.concatenate([[0], np.cumsum(held)])
        lists = pa.array(bounds.astype(np.int32))
        total = np.concatenate([[0], np.cumsum(times)])
        return {
            "n_a": pa.array(np.bincount(doc_a, minlength=n)), "n_b": pa.array(np.bincount(doc_b, minlength=n)), "n_groups": pa.array(np.bincount(doc_of, minlength=n)),
            "n_links": pa.array(np.diff(total[bounds])), "groups_sha256": pa.array(self._written(ids_a, group_a, last_a, ids_b, group_b, last_b, n_groups, doc_of, n), pa.string()),
            "pairs": pa.ListArray.from_arrays(lists, pa.array(pairs)), "times": pa.ListArray.from_arrays(lists, pa.array(times)),
        }

    @staticmethod
    def _groups(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(group of each token, whether a group ends with it), given the tokens with shared ends. Groups are counted through the slice:
        every document ends with a shared end."""
        last = np.zeros(n, bool)
        last[at] = True
        return np.cumsum(last) - last, last

    @staticmethod
    def _links(ids_a, group_a, ids_b, group_b, n_groups, doc_of) -> pa.Table:
        """(doc, pair, n): the links of each document by id pair."""
        dense = np.bincount(group_a, minlength=n_groups) * np.bincount(group_b, minlength=n_groups) > DENSE

        def side(ids, group, name):
            thick = dense[group]
            plain = pa.table({"group": group[~thick], name: ids[~thick], f"n_{name}": np.ones(int((~thick).sum()), np.int64)})
            if not thick.any():
                return plain
            merged = pa.table({"group": group[thick], name: ids[thick]}).group_by(["group", name], use_threads=False).aggregate([([], "count_all")])
            return pa.concat_tables([plain, merged.rename_columns(["group", name, f"n_{name}"])])

        met = side(ids_a, group_a, "a").join(side(ids_b, group_b, "b"), "group", join_type="inner", use_threads=False)
        pair = met["a"].to_numpy().astype(np.int64) << SHIFT | met["b"].to_numpy()
        rows = pa.table({"doc": doc_of[met["group"].to_numpy()], "pair": pair, "n": met["n_a"].to_numpy() * met["n_b"].to_numpy()})
        return rows.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["doc", "pair", "n"])

    def _written(self, ids_a, group_a, last_a, ids_b, group_b, last_b, n_groups, doc_of, n) -> list[str]:
        """The digest of each document's groups as text: tokens of A come before those of B in their group."""
        na, nb = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        final = np.ones(n_groups, bool)
        final[:-1] = doc_of[1:] != doc_of[:-1]
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + (np.cumsum(nb) - nb)[group_a]] = ids_a + self.n * last_a
        code[np.arange(len(ids_b)) + np.cumsum(na)[group_b]] = ids_b + self.n * np.where(last_b, np.where(final[group_b], 3, 2), 0)
        of_doc = np.bincount(doc_of, na + nb, n).astype(np.int64)
        return _digests(pc.take(self.strings, pa.array(code)), np.concatenate([[0], np.cumsum(of_doc)]))


_aligners: dict[int, Aligner] = {}


def _aligner(spec: str, model: bytes) -> Aligner:
    key = hash((spec, model))
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(spec, model)
    return _aligners[key]


def _spaced(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space in front of those that aren't empty."""
    size = np.diff(offs)
    full = (size > 0).astype(np.int64)
    out = np.concatenate([[0], np.cumsum(size + full)])
    spaced = np.full(int(out[-1]), 0x20, np.uint8)
    inside = np.ones(len(spaced), bool)
    inside[out[:-1][full > 0]] = False
    spaced[inside] = data
    return out, spaced


KIND = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) to a row per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (of `a1,a2|b1;a3|b2,b3`), and the
    links by id pair, pairs (A id * 2^32 + B id) with their times. One pass, no shuffle."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((Path(path_a).read_text(encoding="utf-8"), Path(path_b).read_bytes()))

    def run(batches):
        aligner = _aligner(*shared.value)
        for batch in batches:
            offs, data = tx.text_buffers(batch.column(1))
            for at, to in tx.row_slices(offs, SLICE):
                bounds, texts = _spaced(offs[at : to + 1] - offs[at], data[offs[at] : offs[to]])
                made = aligner.align(texts, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *made.values()], names=["doc_id", *made])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, KIND)


def _partial(batches):
    """Documents that hold each pair, in parts."""
    held, rows = [], 0
    summed = lambda: pa.concat_tables(held).group_by("pair").aggregate([("n", "sum")]).rename_columns(["pair", "n"])
    for batch in batches:
        t = pa.table({"pair": pc.list_flatten(batch.column(0))}).group_by("pair").aggregate([([], "count_all")]).rename_columns(["pair", "n"])
        held.append(t)
        rows += t.num_rows
        if rows > PARTIAL:
            held = [summed()]
            rows = held[0].num_rows
            if rows > PARTIAL // 2:
                yield from held.pop().to_batches()
                rows = 0
    if held:
        yield from summed().to_batches()


def pair_counts(links: DataFrame) -> DataFrame:
    """links (pairs) to pair, n: how many rows hold the pair, and best: whether no other pair of its A id has more."""
    parts = links.select("pairs").mapInArrow(_partial, "pair bigint, n bigint")
    counts = written(parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", SHIFT)))
    # A row per A id: bounded by A's vocabulary, but Spark chooses how to join.
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _lookup(shared):
    def run(batches):
        pairs, counts, best = shared.value
        for batch in batches:
            of, times = batch.column(batch.schema.get_field_index("pairs")), batch.column(batch.schema.get_field_index("times"))
            parent = pc.list_parent_indices(of).to_numpy(zero_copy_only=False)
            at = np.searchsorted(pairs, pc.list_flatten(of).to_numpy(zero_copy_only=False))
            n = pc.list_flatten(times).to_numpy(zero_copy_only=False)
            bounds = np.searchsorted(parent, np.arange(batch.num_rows + 1))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (n * best[at], n * counts[at])]
            light = [batch.column(j) for j in range(6)]
            yield pa.RecordBatch.from_arrays([*light, *map(pa.array, sums)], names=[*batch.schema.names[:6], "n_best", "count_sum"])

    return run


def summed_links(links: DataFrame, counts: DataFrame, pairs: int) -> DataFrame:
    """links with n_best (links whose pair is a best one of its A id) and count_sum (counts over all links); pairs: rows of counts."""
    light = [c for c in links.columns if c not in ("pairs", "times")]
    if pairs <= BROADCAST_PAIRS:
        t = counts.toArrow().combine_chunks()
        order = np.argsort(t["pair"].to_numpy())
        shared = links.sparkSession.sparkContext.broadcast(tuple(t[c].to_numpy()[order] for c in ("pair", "n", "best")))
        return links.mapInArrow(_lookup(shared), ", ".join(f"{c} {dict(links.dtypes)[c]}" for c in light) + ", n_best bigint, count_sum bigint")
    row = F.monotonically_increasing_id()
    links = links.withColumn("row", row)
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    sums = each.join(counts, each.pairs == counts.pair).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return links.drop("pairs", "times").join(sums, "row", "left").select(*light, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """docs (doc_id, text) to a row per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum. Links are written
    once; counts and sums read what is written."""
    links = written(aligned(docs, path_a, path_b))
    counts = written(pair_counts(links))
    return summed_links(links, counts, counts.count())
