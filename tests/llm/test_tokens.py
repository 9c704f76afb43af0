"""Operators on tokens against the tokenizers' own libraries and brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from larkspur.llm import alignment, bpe
from larkspur.llm import queries as q

SF = "/root/testdata/sf0.001"
WORDS, BYTES, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOC = "doc_id bigint, text string, lang string, source string, IDS int, decoded int, `__id` int"
LETTERS = "aaaabcİßΣσς é́́'sreve  \t\n  　\x1c\x85漢字각가🙂<|>endoftext_5½Ⅷ٣\x00‍"
AWKWARD = [None, "", "   \n\t ", "one", "one", "Ünïcode ß É 漢字 words", "x" * 30_000, "ab" * 3000, "<|endoftext|>", "a<|endoftext|>b <|startoftext|>'s", "<|endof<|endoftext|>", "It's we'll THEY'RE 12345 !!", "ΑΣ ΣΑΣ", "a\x1cb\x85c", "é ́x", "line\nline\n\n  line ▁ x"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return AWKWARD + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(600)] + ["".join(rng.choice("aeilnorst ") for _ in range(300)) for _ in range(60)]


def docs_of(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i // 2, t, "en", "s", 7, 8, 9) for i, t in enumerate(texts)], DOC)


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_bpe_equals_the_library(spark, texts, path):
    library = Tokenizer.from_file(path)
    rows = bpe.encode(docs_of(spark, texts), path).collect()
    assert sorted(rows[0].asDict()) == sorted(["doc_id", "text", "lang", "source", "decoded", "__id", "ids"])
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids, r.text


def test_bpe_decodes_as_the_library(spark, texts):
    library = Tokenizer.from_file(WORDS)
    rows = bpe.decode(bpe.encode(docs_of(spark, texts), WORDS), WORDS).collect()
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(None,), ([],), ([49407, 320],)], "ids array<int>"), WORDS).collect()] == ["", "", "<|endoftext|> a</w>"]


def test_bpe_query_equals_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = q.op13_bpe(spark, SF).collect()
    assert len(rows) == len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_of_an_empty_table(spark):
    made = bpe.encode(docs_of(spark, AWKWARD).limit(0), WORDS, decoded=True)
    assert made.count() == 0 and made.columns[-2:] == ["ids", "decoded"]


def test_bpe_forgets_and_is_the_same(texts, monkeypatch):
    """With nearly nothing remembered and short slices, ids don't change."""
    import pyarrow as pa

    column = pa.array(texts)
    whole = bpe.encode_column(bpe.Encoder(open(WORDS).read()), column)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "SLICE", 100)
    assert bpe.encode_column(bpe.Encoder(open(WORDS).read()), column).equals(whole)


def brute_groups(texts):
    """(ids of A, ids of B) of each group of each text, by whole texts, sets and searches."""
    a, b, of = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES), {c: i for i, c in enumerate(bpe.byte_alphabet())}
    a.encode_special_tokens = True
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
            yield []
            continue
        end_a, end_b = np.cumsum(list(map(len, raw_a))), np.cumsum(list(map(len, raw_b)))
        shared = sorted(set(end_a) & set(end_b))
        groups = [([], []) for _ in shared]
        for side, ids, ends in ((0, ids_a, end_a), (1, ids_b, end_b)):
            for i, g in zip(ids, np.searchsorted(shared, ends), strict=True):
                groups[g][side].append(i)
        yield groups


def brute_alignment(rows):
    """The query's rows for (doc_id, text) rows."""
    groups = list(brute_groups([t for _, t in rows]))
    links = [Counter((i, j) for x, y in own for i in x for j in y) for own in groups]
    count = Counter(pair for own in links for pair in own)
    most = {}
    for (i, _), n in count.items():
        most[i] = max(n, most.get(i, 0))
    for (doc, _), own, linked in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        digest = hashlib.sha256(text.encode()).hexdigest() if own else ""
        sums = sum(n for p, n in linked.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in linked.items())
        yield (doc, sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), sum(linked.values()), digest, *sums)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, texts, most, monkeypatch):
    """Also with counts joined by shuffle."""
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    rng = random.Random(9)
    more = texts + ["🙂" * 300, "a \n\nb  c", "s é\né \u00a0 x", "▁", " ▁ x", "<s> </s><unk>"] + ["".join(rng.choice(" \n\tab.é") for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    docs = docs_of(spark, more)
    got = alignment.align(docs, BYTES, PIECES)
    assert tuple(got.columns) == ALIGNED
    assert plain(got.collect()) == plain(brute_alignment([(None if i == 3 else i // 2, t) for i, t in enumerate(more)]))


def test_alignment_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert plain(q.op11_alignment(spark, SF).select(*ALIGNED).collect()) == plain(brute_alignment(rows))


def test_alignment_by_small_slices_and_dense_groups(spark, texts, monkeypatch):
    import pyarrow as pa

    from larkspur.llm import textnp as tx

    def aligned():
        aligner = alignment.Aligner(open(BYTES).read(), open(PIECES, "rb").read())
        offs, data = tx.text_buffers(pa.array(texts))
        made = []
        for at, to in tx.row_slices(offs, alignment.SLICE):
            bounds, raw = alignment._spaced(offs[at : to + 1] - offs[at], data[offs[at] : offs[to]])
            columns = aligner.align(raw, bounds)
            made += [(*r, sorted(zip(p, n, strict=True))) for *r, p, n in zip(*(columns[c].to_pylist() for c in columns), strict=True)]
        return made

    whole = aligned()
    for name, value in (("SLICE", 100), ("DENSE", 0), ("REMEMBERED", 5)):
        monkeypatch.setattr(alignment, name, value)
    assert aligned() == whole


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(docs_of(spark, AWKWARD).limit(0), BYTES, PIECES).count() == 0
