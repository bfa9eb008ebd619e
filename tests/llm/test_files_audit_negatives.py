"""Token files, the divergence audit and hard negatives against plain versions, on small inputs made by hand."""

import glob
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glasstide.llm import divergence, negatives, token_files
from glasstide.llm.arrays import text_buffers
from glasstide.llm.queries import QUERIES, byte_vocabulary, word_vocabulary

from .test_operators import awkward, frame, prose

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


# ---- 11: token files -----------------------------------------------------------------------------------------------


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


BITS = ["a", "Z", "é", "ß", "×", "1", "9", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\x85", "　", "'", "'s", "'ll", "’", "-", "<|endoftext|>", "<|", "|>", "endoftext", ".", "!", "€", "中", "🙂", "\x1c", "\x00", "_", "İ", "²", "ª", "д", "ǅ", "ȿ", "ɏ"]


@pytest.mark.parametrize("remembered", [0, 50, 10**6])
def test_pieces_have_the_ids_of_their_texts(remembered):
    """Random runs of what a pre-tokenizer treats differently: pieces, remembered or not, give what whole texts give."""
    draw, encode = random.Random(5), library(byte_vocabulary())
    texts = ["".join(draw.choice(BITS) for _ in range(draw.randrange(25))) for _ in range(4000)] + ["", None, "word " * 500]
    with open(byte_vocabulary(), encoding="utf-8") as f:
        encoder = token_files.TextEncoder(f.read(), remembered)
    assert encoder.apart
    for first in range(0, len(texts), 1500):
        part = texts[first : first + 1500]
        ids, counts = encoder.encode(*text_buffers(pa.array(part, pa.string())))
        for text, got in zip(part, np.split(ids, np.cumsum(counts)[:-1])):
            assert got.tolist() == encode(text), repr(text)


def plain_files(rows, encode, end_id=0):
    """(doc_id, start, ids) in order; rows of one doc_id in any."""
    out, start = [], 0
    for i, text in rows:
        ids = [*encode(text), end_id]
        out.append((i, start, ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("shards", [1, 3, 40])
@pytest.mark.parametrize("vocabulary", [byte_vocabulary, word_vocabulary])
def test_files_hold_all_documents_in_order(spark, tmp_path, shards, vocabulary):
    """Null ids come first; rows that share an id stand together; other columns are ignored, whatever they are called."""
    rows = awkward()
    df = frame(spark, rows).withColumns({"start": F.lit("x"), "IDS": F.lit(1.5), "my.col": F.lit(2)})
    token_files.write_token_files(df, vocabulary(), str(tmp_path / "t"), shards=shards)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert all(r.n_tokens * 4 == len(r.ids) for r in got) and [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])
    encode = library(vocabulary())
    told = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    assert told == Counter((i, tuple(ids)) for i, _, ids in plain_files(rows, encode))


def test_files_are_flat_and_the_manifest_names_them(spark, tmp_path):
    folder = str(tmp_path / "t")
    manifest = token_files.write_token_files(frame(spark, [(i, prose(20, i)) for i in range(50)]), byte_vocabulary(), folder, shards=4)
    shards = sorted(manifest.collect())
    assert len(shards) > 1 and {s["width"] for s in shards} == {2}
    documents = ids = 0
    for s in shards:
        assert (s["first_document"], s["first_id"]) == (documents, ids)
        assert os.path.getsize(f"{folder}/{s['name']}.bin") == 2 * s["ids"] and os.path.getsize(f"{folder}/{s['name']}.idx") == 8 * (s["documents"] + 1)
        documents, ids = documents + s["documents"], ids + s["ids"]
    before = sorted(token_files.read_token_files(spark, folder).collect())
    for kind in ("bin", "idx", "doc"):  # what a lost attempt has left behind is no shard
        with open(f"{folder}/shard-00001-lost.{kind}", "wb") as f:
            f.write(b"half")
    assert sorted(token_files.read_token_files(spark, folder).collect()) == before and len(before) == 50


def test_wide_ids_small_reads_and_other_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "READ_IDS", 7)
    rows = [(f"k{i:02}", prose(i, i)) for i in range(30)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id string, text string"), byte_vocabulary(), str(tmp_path / "t"), end_id=70_000, shards=2)
    got = sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect())
    assert got == plain_files(rows, library(byte_vocabulary()), 70_000)
    assert {r["width"] for r in spark.read.json(str(tmp_path / "t/manifest")).collect()} == {4}


def test_no_documents_give_no_files(spark, tmp_path):
    token_files.write_token_files(frame(spark, []), byte_vocabulary(), str(tmp_path / "t"))
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0 and not glob.glob(str(tmp_path / "t/*.bin"))


@given
def test_token_file_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = [(i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, start, ids in plain_files(docs, library(byte_vocabulary()))]
    assert sorted(map(tuple, QUERIES["op11_token_files"](spark, SF).collect())) == want


# ---- 12: source divergence -----------------------------------------------------------------------------------------


def plain_audit(rows, least=3, top=200):
    term = re.compile("[A-Za-z\x80-\U0010ffff]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    documents, counts, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for w in term.findall((text or "").translate(lower)):
            counts[lang, source][w] += 1
            if i is not None:
                documents[lang, w].add(i)
    out = []
    for lang, sources in groups.items():
        kept = {w for (own, w), d in documents.items() if own == lang and len(d) >= least}
        whole = Counter()
        for s in sources:
            whole.update({w: n for w, n in counts[lang, s].items() if w in kept})
        p = {}
        for s, c in [(None, whole), *((s, counts[lang, s]) for s in sources)]:
            total = sum(c[w] for w in kept) + len(kept)
            p[s] = {w: 1 + 1_000_000_000 * (c[w] + 1) // total for w in kept}
        away = lambda a, b, w: (p[a][w] - p[b][w]) ** 2 // p[b][w]
        for s in sources:
            pairs = [("pair", o, sum(away(s, o, w) for w in kept)) for o in sources if o != s]
            terms = [("term", w, away(s, None, w)) for w in kept if counts[lang, s][w] and p[s][w] > p[None][w]]
            for part in (pairs, sorted(terms, key=lambda r: (-r[2], r[1].encode()))[:top]):
                out += [(lang, s, *r, k + 1) for k, r in enumerate(sorted(part, key=lambda r: (-r[2], r[1].encode())))]
    return sorted(out)


def audited():
    """Terms that share bytes, some cut inside a character; long and rare ones; nulls, repeats, a language without kept terms."""
    draw = random.Random(3)
    words = ["über", "überall", "üb", "a", "ab", "abcd", "abcde", "Abcdefgh", "abcdefghi", "naïve", "中文字", "中文", "x" * 70, "x" * 71, "y" * 300]
    rows = [(i, " ".join(draw.choice(words) + draw.choice(["", "", f"{'q' * draw.randrange(9)}", "1", "-"]) for _ in range(draw.randrange(40))), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", ""])) for i in range(60)]
    rows += [rows[3], rows[3], (3, "rare rare", "en", "s1"), (None, "ghost über", "en", "s9"), (None, "ghost", "en", "s9"), (None, "ghost", "en", "s9")]
    rows += [(70, None, "en", "empty"), (71, "", None, None), (72, "one two", "xx", "s1"), (73, "three", "xx", "s2"), (74, "only", "zz", "s1"), (75, "long " * 20_000 + "über", "de", "s1")]
    return rows


DOCS = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("chunk,first", [(1 << 24, 4), (300, 1)])
def test_audit_is_the_plain_one(spark, monkeypatch, chunk, first):
    """Whatever the size of lots and of the first prefixes; other columns are ignored."""
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "CELLS", 7)
    monkeypatch.setattr(divergence.kept_terms, "__defaults__", (divergence.LEAST_DOCUMENTS, first))
    df = spark.createDataFrame(audited(), DOCS).repartition(5).withColumns({"TERM": F.lit(1), "part": F.lit("x"), "my.col": F.lit(2), "value": F.lit(3)})
    assert sorted(map(tuple, divergence.audit(df).collect())) == plain_audit(audited())
    assert sorted(map(tuple, divergence.audit(df, top=2).collect())) == plain_audit(audited(), top=2)


def test_refinement_keeps_what_counting_keeps(spark):
    rows = audited()
    told = divergence.term_rows(divergence._plain(spark.createDataFrame(rows, DOCS).repartition(7)), 3)
    documents = defaultdict(set)
    for i, text, lang, _ in rows:
        for w in re.findall("[a-z\x80-\U0010ffff]+", (text or "").lower()):
            documents[lang or "", w].add(i)
    want = {k for k, d in documents.items() if len(d - {None}) >= 3}
    assert {tuple(r) for r in divergence.kept_terms(told, 3).collect()} == want and ("en", "ghost") not in want


def test_shares_are_exact_beyond_64_bits():
    counts, total = np.array([0, 7, 10**12, 3 * 10**15]), 4 * 10**15 + 1
    assert divergence._scaled(counts, total).tolist() == [1 + 10**9 * (int(n) + 1) // total for n in counts]


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    one = divergence.audit(spark.createDataFrame([(1, "a b", "en", "s"), (2, None, "en", "t")], DOCS)).collect()
    assert sorted(map(tuple, one)) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


# ---- 13: hard negatives --------------------------------------------------------------------------------------------


def plain_negatives(rows, is_anchor, positives=5, count=3):
    good = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            row = (label, [int(np.floor(256 * c)) for c in x])
            good[i] = min(good.get(i, row), row)
    out = []
    for a in filter(is_anchor, good):
        label, own = good[a]
        scored = sorted((-sum(p * q for p, q in zip(own, v)), i, other == label) for i, (other, v) in good.items() if i != a and len(v) == len(own) and own)
        for score, p, _ in [s for s in scored if s[2]][:positives]:
            fit = [(-s, i) for s, i, same in scored if not same and 50 * -score <= 100 * -s <= 95 * -score][:count]
            out += [(a, p, k + 1, i, -score, s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>"


def vectors(scale=1.0):
    """Few values, so that ties abound; repeated rows, shared ids, two lengths, zero vectors, and rows that take no part."""
    draw = np.random.default_rng(6)
    rows = [(i, int(draw.integers(0, 3)), [float(x) * scale for x in draw.integers(-2, 6, 20) / 8]) for i in range(160)]
    rows += [(200 + i, i % 2, [float(x) * scale for x in draw.integers(0, 4, 3) / 4]) for i in range(30)]
    rows += [rows[5], rows[10], (10, 1, rows[11][2]), (300, 1, [0.0] * 20), (310, 0, [0.0] * 20), (320, 1, []), (330, 0, [])]
    rows += [(None, 1, rows[0][2]), (340, None, rows[0][2]), (350, 1, None), (360, 1, [None, *rows[0][2][1:]]), (370, 1, [float("nan"), *rows[0][2][1:]]), (380, 0, [float("inf"), *rows[0][2][1:]])]
    return rows


@pytest.mark.parametrize("step,block,scale", [(16, 65_536, 1.0), (3, 1, 1.0), (7, 20, 30_000.0)])
def test_negatives_are_the_plain_ones(spark, monkeypatch, step, block, scale):
    """In blocks and steps of any size, with floats and, where scores are large, integers."""
    monkeypatch.setattr(negatives, "STEP", step)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "LEAST_ROWS", block)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", max(block, 5))
    df = spark.createDataFrame(vectors(scale), VECTORS).repartition(3).withColumns({"asked": F.lit(1), "V": F.lit("x"), "my.col": F.lit(2)})
    want = plain_negatives(vectors(scale), lambda i: i % 10 == 0)
    assert len(want) > 50 and sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == want


def test_windows_take_both_ends_and_no_more():
    block = negatives.Block(np.arange(6), np.zeros(6, int), np.array([[50.0], [49.0], [95.0], [96.0], [95.0], [70.0]]))
    (at, score), (none, _) = negatives.best_in_windows(np.array([1.0]), block, np.arange(6), np.array([50.0, 60.0]), np.array([95.0, 65.0]), 3)
    assert at.tolist() == [2, 4, 5] and score.tolist() == [95, 95, 70] and not len(none)


def test_negatives_of_nothing_and_of_too_much(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], VECTORS), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([(1, 1, [1e10] * 4), (2, 1, [1.0] * 4)], VECTORS), F.lit(True))
