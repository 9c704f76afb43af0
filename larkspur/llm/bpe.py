"""BPE encoding and decoding by dynamic programming over prefixes.

Each prefix of a piece has one last token in its BPE encoding. An automaton of all tokens reports, at every position,
the tokens that end there; the one whose prefix before it ends with a token that stays apart from it is the last token
of the prefix. Two tokens stay apart if no merge across their border comes before the merges that take its two sides
away: the chains of tokens that grow to the border, from single bytes to the whole tokens, are walked once by rank. The
ids follow from the last tokens, from the end backwards: time is linear in a piece's length, however long.

The file's own normalizer and pre-tokenizer make the pieces. Where white space separates pieces, texts are cut at ASCII
white space, the cuts of an Arrow batch are brought to distinct values, and encoded values are remembered up to a bound.

Defined results: null and empty texts have no ids and decode to the empty text; strings of added tokens in a text are
those tokens, as in the library; repeated rows and null doc_ids are rows of their own; extra columns are carried along,
except those named ids and decoded, which are replaced whatever their case."""

from __future__ import annotations

import json
import re
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from larkspur.llm import textnp as tx

#: Remembered values of a worker: what is more is encoded anew.
REMEMBERED = 1 << 19
#: A longer value is encoded at each occurrence and not remembered.
LONG = 200
NEVER = 1 << 40
#: The split for which graphic ASCII texts need no library call (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes of text taken together.
SLICE = 8 << 20
GRAPHIC = re.compile(r"[!-~]+").fullmatch


def byte_alphabet() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, the others by letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Encoder:
    """The tables of a BPE file (JSON text): tokens as strings of symbols, merges by rank, the automaton of tokens. A symbol is a
    byte, or 256 + byte for a piece's last byte where the file marks the ends of words."""

    def __init__(self, spec: str):
        import ahocorasick
        from tokenizers import Tokenizer

        file = json.loads(spec)
        model, end = file["model"], file["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in file["added_tokens"]):
            raise ValueError("only byte-level BPE files with plain added tokens are supported")
        self.library = Tokenizer.from_str(spec)
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        letters = byte_alphabet()
        self.byte_of = {ord(c): b for b, c in enumerate(letters)}
        symbols = {self.vocab[c]: chr(b) for b, c in enumerate(letters)}
        if end:
            symbols |= {self.vocab[c + end]: chr(256 + b) for b, c in enumerate(letters)}
        self.marked = bool(end)
        self.merge: dict[tuple[int, int], int] = {}
        #: Rank of the merge that makes a token; single symbols have none.
        self.rank = dict.fromkeys(symbols, -1)
        left, right = {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            if whole in symbols:
                raise ValueError("two merges make one token")
            symbols[whole], left[whole], right[whole], self.rank[whole], self.merge[a, b] = symbols[a] + symbols[b], a, b, rank, rank
        self.left, self.right, self.apart_memo = left, right, {}
        self.tokens = ahocorasick.Automaton()
        for t, s in symbols.items():
            # A token that BPE never makes of its own string can't be a last token.
            if t not in left or self.apart(left[t], right[t], self.rank[t]):
                self.tokens.add_word(s, (len(s), t))
        self.tokens.make_automaton()
        self.length = {t: len(s) for t, s in symbols.items()}
        pieces = lambda text: "".join(p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        self.separated = pieces("a b") == "ab" and pieces("a\nb") == "ab"
        split = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        lower = '"Lowercase"' in json.dumps(file.get("normalizer"))
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall if split == PATTERN and lower else None
        self.values: dict[str, bytes] = {}
        self.pieces: dict[str, array] = {}

    def grown(self, token: int, side: dict[int, int]) -> list[int]:
        """The tokens at one border of a token, from a single symbol to itself."""
        out = [token]
        while out[-1] in side:
            out.append(side[out[-1]])
        return out[::-1]

    def apart(self, a: int, b: int, before: int = NEVER) -> bool:
        """Whether BPE leaves a and b as they are when they stand side by side, as far as merges of a rank below `before` go."""
        x, y, i, j = self.grown(a, self.right), self.grown(b, self.left), 0, 0
        while True:
            left_goes = self.rank[x[i + 1]] if i + 1 < len(x) else NEVER
            right_goes = self.rank[y[j + 1]] if j + 1 < len(y) else NEVER
            across = self.merge.get((x[i], y[j]), NEVER)
            # Of equal merges the leftmost comes first.
            if across < min(before, left_goes) and across <= right_goes:
                return False
            if left_goes == right_goes == NEVER:
                return True
            if left_goes <= right_goes:
                i += 1
            else:
                j += 1

    def encode_symbols(self, s: str) -> array:
        """Ids of one piece."""
        last, memo = [-1] * (len(s) + 1), self.apart_memo
        for at, (n, t) in self.tokens.iter(s):
            if last[at + 1] < 0:
                before = at + 1 - n
                if before:
                    a = last[before]
                    if a < 0:
                        continue
                    key = a << 32 | t
                    stay = memo.get(key)
                    if stay is None:
                        if len(memo) >= REMEMBERED:
                            memo.clear()
                        stay = memo[key] = self.apart(a, t)
                    if not stay:
                        continue
                last[at + 1] = t
        out, i = array("i"), len(s)
        while i:
            out.append(last[i])
            i -= self.length[last[i]]
        out.reverse()
        return out

    def encode_piece(self, piece: str) -> array:
        """piece: bytes as Latin-1 letters."""
        found = self.pieces.get(piece)
        if found is None:
            found = self.encode_symbols(piece[:-1] + chr(256 + ord(piece[-1])) if self.marked else piece)
            if len(piece) <= LONG:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def encode_plain(self, text: str, out: array) -> None:
        """Text without added tokens."""
        if self.ascii and GRAPHIC(text):
            pieces = self.ascii(text.lower())
        else:
            if self.library.normalizer is not None:
                text = self.library.normalizer.normalize_str(text)
            pieces = [p.translate(self.byte_of) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        for piece in pieces:
            out.extend(self.encode_piece(piece))

    def encode(self, text: str) -> array:
        out, at = array("i"), 0
        for m in self.specials.finditer(text) if self.specials and "<" in text else ():
            self.encode_plain(text[at : m.start()], out) if m.start() > at else None
            out.append(self.added[m.group()])
            at = m.end()
        if at < len(text):
            self.encode_plain(text[at:] if at else text, out)
        return out

    def encode_value(self, text: str) -> bytes:
        found = self.values.get(text)
        if found is None:
            found = self.encode(text).tobytes()
            if len(text) <= LONG:
                if len(self.values) >= REMEMBERED:
                    self.values.clear()
                self.values[text] = found
        return found


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(distinct texts of the byte spans, index of each span's text). Spans are in order and don't overlap."""
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    if bounds[-1] == len(data):
        body = data
    else:
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, start, 1)
        np.subtract.at(edge, end, 1)
        body = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    texts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body))).dictionary_encode()
    return texts.dictionary, texts.indices.to_numpy(zero_copy_only=False)


def gathered(codes: np.ndarray, values: np.ndarray, sizes: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lists of values (one after another or from `first` on, with their sizes) taken by codes: (all values, size of each list taken)."""
    first = np.cumsum(sizes) - sizes if first is None else first
    taken = sizes[codes]
    ends = np.cumsum(taken)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[codes] - (ends - taken), taken)
    return values[at], taken


def encode_column(encoder: Encoder, column: pa.Array) -> pa.ListArray:
    """Texts to lists of ids."""
    offs, data = tx.text_buffers(column)
    ids, counts = [], []
    for at, to in tx.row_slices(offs, SLICE):
        part, own = data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        if encoder.separated:
            w = tx.split(part, own, tx.SPACE, lower=False)
            start, end, first = w.start, w.end, w.first
        else:
            start, end = (x[np.diff(own) > 0] for x in (own[:-1], own[1:]))
            first = np.searchsorted(start, own)
        texts, codes = distinct_spans(part, start, end)
        found = [encoder.encode_value(x) for x in texts.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        values, taken = gathered(codes, np.frombuffer(b"".join(found), np.int32), sizes)
        ids.append(values)
        counts.append(np.diff(np.concatenate([[0], np.cumsum(taken)])[first]))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def decode_column(names: pa.Array, lists: pa.ListArray) -> pa.Array:
    """Lists of ids to texts: their tokens' strings joined by spaces, as the library does for a file without a decoder."""
    if not len(lists):
        return pa.array([], pa.large_string())
    lists = pc.fill_null(lists, []) if lists.null_count else lists
    taken = pc.take(names, pc.list_flatten(lists))
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), taken), pa.scalar(" ", pa.large_string()))


def token_names(spec: str) -> pa.Array:
    """The string of each id."""
    file = json.loads(spec)
    if file.get("decoder"):
        raise ValueError("files with a decoder are not supported")
    by_id = {i: t for t, i in file["model"]["vocab"].items()} | {x["id"]: x["content"] for x in file["added_tokens"]}
    return pa.array([by_id.get(i, "") for i in range(max(by_id) + 1)], pa.large_string())


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One encoder per worker process and file: what it remembers serves later tasks."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def _with(df: DataFrame, *made: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in made])


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with a column ids: the BPE ids of its text by the tokenizer file at path (read by the driver), without special tokens
    around it; and, if asked for, with the column decoded, made of these ids. One pass, no shuffle."""
    spec = Path(path).read_text(encoding="utf-8")
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kept = _with(docs, "ids", *["decoded"] * decoded)
    at, names = kept.columns.index(text), kept.columns

    def run(batches):
        encoder = _encoder(shared.value)
        strings = token_names(shared.value) if decoded else None
        for batch in batches:
            ids = encode_column(encoder, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, *([decode_column(strings, ids)] if decoded else [])], names=[*names, "ids", *["decoded"] * decoded])

    schema = StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType())), *[StructField("decoded", StringType())] * decoded])
    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (ids) with a column decoded: the text of the ids by the tokenizer file at path; null ids decode to the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    kept = _with(rows, "decoded")
    at, names = kept.columns.index("ids"), kept.columns
    def run(batches):
        strings = token_names(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_column(strings, batch.column(at))], names=[*names, "decoded"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", StringType())]))
