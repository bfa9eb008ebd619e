"""Plain single-machine versions of the operators, written from the contracts, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def base_secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def repeats(docs: list[tuple[int, str | None]], width: int = 13) -> dict[int, tuple[int, int, str]]:
    """doc_id -> n_words, n_removed, sha of the kept words."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for k in range(width)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingle_set(text: str | None, n: int = 5) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar(docs: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, tuple[int, int]]:
    """doc_id -> class (least id of its connected component), number of links."""
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (find(d), links[d]) for d in ids}


ALPHABETS = {
    "decimal": "0123456789", "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_-]{16,}")


def _tail(z: float) -> float:
    return max(1e-12, 0.5 * (1 - math.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3))))


def battery(token: str) -> tuple[str, float] | None:
    """Stratum and joint p-value of a token by the three tests, written out; None for one that holds under 64 bits."""
    forms = (("decimal", "[0-9]+"), ("hex", "[0-9a-f]+|[0-9A-F]+"), ("base32", "[A-Z2-7]+"), ("base36", "[0-9a-z]+|[0-9A-Z]+"), ("base64", ".*"))
    kind = next(k for k, form in forms if re.fullmatch(form, token))
    letters, n = ALPHABETS[kind], len(token)
    size = len(letters)
    if n * math.log2(size) < 64:
        return None
    token = token.lower() if kind in ("hex", "base36") else token.translate(str.maketrans("-_", "+/"))
    code = [letters.index(c) + 1 for c in token]
    chi = (size / n * sum(v * v for v in Counter(code).values()) - n - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n))
    mean = sum(code) / n
    lag = (sum(a * b for a, b in zip(code, code[1:])) / (n - 1) - mean * mean) / max(sum(c * c for c in code) / n - mean * mean, 1e-9)
    high = [c > size / 2 for c in code]
    runs, up = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    want = 2 * up * (n - up) / n + 1
    p_runs = 1e-12 if want <= 2 else min(1.0, 2 * _tail(abs(runs - want) / math.sqrt(max((want - 1) * (want - 2) / (n - 1), 1e-9))))
    half = -(math.log(_tail(chi)) + math.log(p_runs) + math.log(min(1.0, 2 * _tail(abs(lag) * math.sqrt(n)))))
    return f"{kind}:{int(math.log2(n))}", math.exp(-half) * (1 + half + half * half / 2)


def secret_spans(docs: list[tuple[int, str | None]], alpha: float = 0.1) -> dict[int, str]:
    """doc_id -> all spans as written: base spans, and random tokens that touch none of them, cut off by stratum."""
    steps = (1e-9, 1e-6, 1e-4, 1e-3, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5)
    tested = {d: [(m.start(), m.end(), *got) for m in TOKEN.finditer(t or "") if (got := battery(m[0]))] for d, t in docs}
    by: dict[str, list[float]] = {}
    for found in tested.values():
        for _, _, stratum, p in found:
            by.setdefault(stratum, []).append(p)
    least = {}
    for stratum, ps in by.items():
        random = 2 * sum(p >= 0.5 for p in ps)
        for step in steps:
            accepted = sum(p >= step for p in ps)
            if accepted and max(0.0, accepted - random * (1 - step)) <= alpha * accepted:
                least[stratum] = step
                break
    out = {}
    for d, t in docs:
        spans = base_secrets(t)
        extra = [(a, 3, "random", b) for a, b, s, p in tested[d] if p >= least.get(s, 2) and not any(x < b and a < y for x, _, _, y in spans)]
        out[d] = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans + extra))
    return out


SYMBOLS = b"!*$&%#|.,;:?-_/()\"'<>=+@\n "


def statistics(text: str | None) -> list[float]:
    """The quality statistics of one text, one after the other."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * (17 + len(SYMBOLS) + 6)
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", raw), [x for x in raw.split(b"\n") if x]
    low, n, k = [w.lower() for w in words], max(1, len(words)), max(1, len(lines))
    upper = lambda b: 65 <= b <= 90
    second = [w[max(len(w) - 2, 0)] for w in words]
    ends = [w[-1] in SYMBOLS for w in words]
    out = [math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)), sum(map(len, words)) / n, sum(len(w) ** 2 for w in words) / n]
    out += [len(set(low)) / n, max(Counter(low).values(), default=0) / n, sum(a == b for a, b in zip(low, low[1:])) / n]
    out += [sum(e and w[-1] == s for e, w, s in zip(ends, words, second)) / n, sum(ends) / n, sum(upper(w[0]) for w in words) / n]
    out += [sum(upper(w[0]) and upper(s) for w, s in zip(words, second)) / n, sum(len(w) == 1 for w in words) / n, sum(len(w) > 12 for w in words) / n]
    out += [len(set(lines)) / k, len(words) / k, len(set(low)) / math.sqrt(n)]
    classes = [lambda b: upper(b), lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b < 32 and b != 10, None, lambda b: b >= 128]
    shares = [raw.count(bytes([b])) / len(raw) for b in SYMBOLS] + [sum(map(c, raw)) / len(raw) if c else 0.0 for c in classes]
    shares[len(SYMBOLS) + 4] = max(0.0, 1 - sum(shares))
    return out + shares
