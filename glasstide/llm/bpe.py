"""BPE encoding and decoding with a public vocabulary file, inside Arrow batches.

Character classes are those of the regex module, whose Unicode version may be newer than the vocabulary library's: only
letters and digits assigned since then can split otherwise. Words are merged by a priority queue of merge ranks over a doubly linked list of symbols; queue entries whose symbols
have changed meanwhile are stale and skipped. Decoding concatenates vocabulary strings. Each process remembers the words
that its tasks have merged, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import without_dots

#: Words that a process remembers before it forgets them all.
REMEMBERED = 400_000
#: White space as the vocabulary's normalizer takes it (the White_Space property).
WHITE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: The settings of a tokenizer file that encoding follows.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The pattern of words that never reach across white space, so that what stands between is cut by itself.
APART = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: What str.split takes for white space beyond WHITE.
NOT_WHITE = "\x1c\x1d\x1e\x1f"


def load_vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer file with word ends: ids, merge ranks, special tokens, the pattern of words; and its digest.

    A file that asks for other normalising, decoding or fallbacks than are built here is refused.
    """
    with open(path, "rb") as f:
        content = f.read()
    spec = json.loads(content)
    model = spec["model"]
    normal = spec.get("normalizer") or {}
    asked = {
        "normalizer": normal.get("normalizers", [normal]) != NORMALIZERS, "decoder": spec.get("decoder") is not None, "post_processor": spec.get("post_processor") is not None,
        "model": model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "added_tokens": any(t.get("normalized") or t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])),
    }
    if any(asked.values()):
        raise ValueError(f"{path}: unknown settings of {', '.join(k for k, v in asked.items() if v)}")
    ids = model["vocab"]
    ranks = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        ranks.setdefault((a, b), rank)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    words = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    digest = hashlib.sha256(content).hexdigest()
    return {"ids": ids, "ranks": ranks, "special": special, "words": words.replace(r"\s", WHITE), "apart": words == APART, "end": model.get("end_of_word_suffix") or "", "digest": digest}


def merge_word(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """symbols after all merges, lowest rank first and leftmost among equals."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(queue)
    alive: list[str | None] = list(symbols)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = right[i]
        if alive[i] != a or j < 0 or alive[j] != b:
            continue  # stale: one of the two has been merged since
        alive[i], alive[j] = a + b, None
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get((a + b, alive[k]))) is not None:
                heapq.heappush(queue, (r, i, a + b, alive[k]))
        h = left[i]
        if h >= 0 and (r := ranks.get((alive[h], a + b))) is not None:
            heapq.heappush(queue, (r, h, alive[h], a + b))
    return [s for s in alive if s is not None]


class Encoder:
    """Encodes texts as the vocabulary file says; holds a process's memory of merged words."""

    def __init__(self, vocabulary: dict, remembered: int = REMEMBERED):
        self.ids, self.ranks, self.special, self.apart, self.end = (vocabulary[k] for k in ("ids", "ranks", "special", "apart", "end"))
        self.words = regex.compile(vocabulary["words"])
        self.parts = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.white = regex.compile(f"[{WHITE}]+")
        self.letters = byte_letters()
        self.piece = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.remembered = remembered
        self.known: dict[str, tuple[int, str, str]] = {}

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by a space, and their vocabulary strings joined by a space."""
        if len(self.known) >= self.remembered:
            self.known.clear()
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        found = [i for s in merge_word(symbols, self.ranks) if (i := self.ids.get(s)) is not None]
        self.known[word] = out = (len(found), " ".join(map(str, found)), " ".join(self.piece[i] for i in found))
        return out

    def normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def found(self, text: str) -> list[tuple[int, str, str]]:
        """As word(), for each word of a text without special strings. A stretch between white space that is a remembered word is not cut."""
        known, word, findall = self.known, self.word, self.words.findall
        text = self.normal(text)
        if not self.apart or any(c in text for c in NOT_WHITE):
            return [known.get(w) or word(w) for w in findall(self.white.sub(" ", text))]
        found = []
        for stretch in text.split():
            got = known.get(stretch)
            if got is None:
                found += [known.get(w) or word(w) for w in findall(stretch)]
            else:
                found.append(got)
        return found

    def encode(self, text: str) -> tuple[int, str, str]:
        """As word(), for a whole text. Special strings are taken out before anything is normalised."""
        found: list[tuple[int, str, str]] = []
        pieces = self.parts.split(text) if self.parts and any(t in text for t in self.special) else [text]
        for piece in pieces:
            if piece in self.special:
                i = self.special[piece]
                found.append((1, str(i), self.piece[i]))
            else:
                found += self.found(piece)
        found = [x for x in found if x[0]]
        if not found:
            return 0, "", ""
        counts, ids, strings = zip(*found)
        return sum(counts), " ".join(ids), " ".join(strings)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: dict) -> Encoder:
    """The process's encoder of a vocabulary: its memory of words outlives a task. Only the last one is kept."""
    key = vocabulary["digest"]
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode_texts(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """documents' rows with n_tokens (long), ids (decimal, joined by a space) and decoded (vocabulary strings, so joined).

    A null text counts as empty: no tokens, empty ids and decoded text; a very long text is encoded whole; repeated rows each get
    a result; an empty table gives no rows. Other columns stay, but for ones named like a result, whatever the case. The file
    names no decoder, so vocabulary strings are joined as they are. It is read on the driver and broadcast: its size is fixed.
    """
    columns = [c for c in documents.columns if c.lower() not in ("n_tokens", "ids", "decoded")]
    source, names = without_dots(documents, columns)
    vocabulary = documents.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            texts = batch.column(columns.index("text"))
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [encoder.encode(t or "") for t in texts.slice(at, 500).to_pylist()]
                new = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, "n_tokens", "ids", "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(encoded, f"{kinds}, n_tokens long, ids string, decoded string").toDF(*columns, "n_tokens", "ids", "decoded")
