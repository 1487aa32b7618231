"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of the base patterns, as listed.
KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans; secrets (keys, tokens, passwords of machines) come from the field alone.
ALL_KINDS = (*KINDS, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile("[A-Za-z]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches, found from each @: the part before it is the whole run of allowed characters since the last match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        if i < at and (m := _DOMAIN.match(text, at + 1)):
            yield i, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(i, 0, j) for i, j in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x) < 4 and int(x) < 256 or int(x[-4:]) < 256 and not x[:-3].strip("0") for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


# --- the random field -----------------------------------------------------------------------
#: A window is a stretch of text that can hold a span which the base patterns miss: a name written out around "at" and "dot", an address with
#: its dots in brackets, many digits, or a long run of letters and digits without a space.
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[({ ]\s?at\s?[\])} ]\s?[A-Za-z0-9-]{1,63}(?:\s?[\[({ ]\s?dot\s?[\])} ]\s?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,4}", re.I)
_PARTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?[0-9]{1,3}){3}(?![0-9])", re.I)
_DIGITS = re.compile(r"[(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}+")
_RUN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_SPELT_HINT = re.compile(r"[\[({ ]dot[\])} ]|[\[({]\s?at\s?[\])}]", re.I)
_PARTED_HINT = re.compile(r"[0-9]\s?[\[({]\s?(?:\.|dot)\s?[\])}]", re.I)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|\s+")
_CUE = {"phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "dial": "phone", "mail": "email", "email": "email", "contact": "email", "write": "email", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "address": "ip", "isbn": "not", "order": "not", "ref": "not", "version": "not", "id": "not", "invoice": "not", "date": "not", "token": "secret", "secret": "secret", "key": "secret", "apikey": "secret", "password": "secret", "passwd": "secret", "pwd": "secret", "bearer": "secret", "credential": "secret", "sha": "not", "md5": "not", "commit": "not", "digest": "not", "hash": "not", "etag": "not", "uuid": "not"}
_UUID = re.compile("[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: The bounds of an entity, without which the dynamic programme would be quadratic in a window.
MAX_TOKENS, MAX_PARTS = 24, 6
#: No card, phone number or address has more digits.
MAX_DIGITS = 25


def _shape(s: str) -> str:
    return "-".join(str(min(len(x), 9)) for x in re.findall("[0-9]+", s))


def _cue(text: str, lo: int) -> str:
    """What the nearest telling word before a place speaks of."""
    before = re.findall("[A-Za-z]+[0-9]?", text[max(0, lo - 24) : lo])
    return next((_CUE[w.lower()] for w in reversed(before) if w.lower() in _CUE), "none")


def _secrets(text: str, lo: int, hi: int):
    """Candidate secrets of a window: up to MAX_PARTS neighbouring parts of a run of letters and digits."""
    for run in _RUN.finditer(text, lo, hi):
        parts = [m.span() for m in re.finditer("[A-Za-z0-9]+", run[0])]
        cue = _cue(text, run.start())
        for a, (i, _) in enumerate(parts):
            for _, j in parts[a : a + MAX_PARTS]:
                s = run[0][i:j]
                if len(s) < 16:
                    continue
                i0, j0 = i + run.start(), j + run.start()
                whole = not (i0 and (text[i0 - 1].isalnum() or text[i0 - 1] in "_+/=-")) and not (j0 < len(text) and (text[j0].isalnum() or text[j0] in "_+/-"))
                quoted = i0 > 0 and j0 < len(text) and text[i0 - 1] == text[j0] and text[j0] in "\"'`"
                digits = sum(c in "0123456789" for c in s)
                cases = (any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s))
                turns = sum((x in "0123456789") != (y in "0123456789") for x, y in zip(s, s[1:], strict=False))
                yield i0, j0, "secret", ("secret", f"secret whole {whole}", f"secret quoted {quoted}", f"secret cue {cue}", f"secret cue {cue} {whole}", f"secret hex {not set(s.lower()) - set('0123456789abcdef')}", f"secret digits {10 * digits // len(s)}", f"secret cases {sum(cases)}", f"secret kinds {min(len(set(s)) // 4, 6)}", f"secret turns {min(6, 10 * turns // len(s))}", f"secret length {min(len(s) // 8, 9)}", f"secret uuid {bool(_UUID.fullmatch(s))}")


def segments(text: str, lo: int, hi: int):
    """Candidate segments of a window: (start, end, kind, features); features look at the whole span and at what stands beside it."""
    toks = [(m.start() + lo, m.end() + lo) for m in _TOKEN.finditer(text[lo:hi])]
    cue = _cue(text, lo)
    yield from _secrets(text, lo, hi)
    digits = [0, *accumulate(j - i if text[i] in "0123456789" else 0 for i, j in toks)]
    letters = [0, *accumulate(text[i].isalpha() and text[i].isascii() for i, _ in toks)]
    for a, (i, _) in enumerate(toks):
        if text[i].isspace():
            continue
        for b in range(a, min(len(toks), a + MAX_TOKENS)):
            j, n = toks[b][1], digits[b + 1] - digits[a]
            if n > MAX_DIGITS and letters[b + 1] == letters[a]:
                continue
            s = text[i:j]
            if s[-1].isspace() or not (s[-1].isalnum()):
                continue
            clean = not (i and (text[i - 1].isalnum() or text[i - 1] in "_-./@+")) and not (j < len(text) and (text[j].isalnum() or text[j] in "_/@" or text[j] == "-"))
            if _PARTED.fullmatch(s):
                parts = [int(x) for x in re.findall("[0-9]+", s)]
                yield i, j, "ip", ("ip", f"ip clean {clean}", "ip parted", f"ip byte {max(parts) < 256}", f"ip cue {cue}")
            elif n >= 7 and not re.search("[A-Za-z]", s):
                shape, ok = _shape(s), n >= 14 and luhn(re.sub("[^0-9]", "", s))
                for kind in ("phone", "card", "ip"):
                    yield i, j, kind, (f"{kind}", f"{kind} clean {clean}", f"{kind} shape {shape}", f"{kind} n {n}", f"{kind} luhn {ok}", f"{kind} cue {cue}", f"{kind} open {s[0] == '('}", f"{kind} groups {min(shape.count('-'), 6)}", f"{kind} slash {'/' in s}")
            elif re.search(r"\bat\b", s, re.I) and re.search(r"[A-Za-z]$", s):
                last = re.split(r"[^A-Za-z0-9]+", s)[-1].lower()
                yield i, j, "email", ("email", f"email clean {clean}", f"email brackets {bool(re.search(r'[\[({]', s))}", f"email dots {min(3, len(re.findall(r'[^a-z]dot[^a-z]', s, re.I)))}", f"email tld {last in ('com', 'org', 'net', 'edu', 'de', 'fr', 'es', 'io', 'gov')}", f"email cue {cue}", f"email dot {'.' in s}")


def _windows(text: str, taken: list[tuple[int, int, int]]):
    """Windows of the text between the base spans, each of which may leave some on both sides; windows that overlap are one, so that the field chooses among their kinds."""
    patterns = [_DIGITS]
    if _SPELT_HINT.search(text):
        patterns.append(_SPELT)
    if _PARTED_HINT.search(text):
        patterns.append(_PARTED)
    found, done = [], 0
    for i, j in [*sorted((i, j) for i, _, j in taken), (len(text), len(text))]:
        if i > done:
            for p in patterns:
                found += [m.span() for m in p.finditer(text, done, i)]
            found += [m.span() for m in _RUN.finditer(text, done, i) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]
        done = max(done, j)
    lo = hi = -1
    for i, j in sorted(found):
        if i >= hi:
            if hi > lo:
                yield lo, hi
            lo, hi = i, j
        hi = max(hi, j)
    if hi > lo:
        yield lo, hi


def _lattice(text: str, lo: int, hi: int, weights: dict) -> tuple[list[int], dict]:
    found = list(segments(text, lo, hi))
    ends = sorted({lo, hi, *(x[0] for x in found), *(x[1] for x in found)})
    at = {x: k for k, x in enumerate(ends)}
    by_end: dict = defaultdict(list)
    for i, j, kind, feats in found:
        by_end[at[j]].append((at[i], kind, feats, sum(weights.get(f, 0.0) for f in feats)))
    return ends, by_end


def decode(text: str, lo: int, hi: int, weights: dict) -> list[tuple[int, int, int]]:
    """The best segmentation of a window; what is outside of spans scores 0."""
    ends, by_end = _lattice(text, lo, hi, weights)
    best: list = [(0.0, None)]
    for k in range(1, len(ends)):
        here = (best[k - 1][0], None)
        for a, kind, _, score in by_end[k]:
            if (s := best[a][0] + score) > here[0]:
                here = (s, (a, kind))
        best.append(here)
    out, k = [], len(ends) - 1
    while k > 0:
        if best[k][1] is None:
            k -= 1
        else:
            a, kind = best[k][1]
            out.append((ends[a], ALL_KINDS.index(kind), ends[k]))
            k = a
    return out[::-1]


def _made(rng: random.Random) -> tuple[str, tuple[int, int, str] | None]:
    """An invented sentence with at most one span that the base patterns miss."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))
    kind = rng.choice(["phone", "phone", "card", "email", "email", "ip", "secret", "secret", None, None, None, None, None])
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    if kind == "phone":
        s = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}"])
        lead = rng.choice(["call ", "phone ", "tel ", "mobile ", w() + " "])
    elif kind == "card":
        x = d(15)
        x += next(c for c in "0123456789" if luhn(x + c))
        s, lead = rng.choice([".", "/"]).join(x[k : k + 4] for k in (0, 4, 8, 12)), rng.choice(["card ", "visa ", w() + " "])
    elif kind == "email":
        at, dot = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "."), (" (at) ", ".")])
        s, lead = f"{w()}{at}{w()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'io'])}", rng.choice(["mail ", "contact ", "write ", w() + " "])
    elif kind == "ip":
        dot = rng.choice(["[.]", "(.)", "[dot]", " [.] ", " (dot) "])
        s, lead = dot.join(str(rng.randint(0, 255)) for _ in range(4)), rng.choice(["ip ", "host ", "address ", w() + " "])
    elif kind == "secret":
        s = rng.choice([of(hexa, rng.choice([32, 40, 64])), of(hexa, rng.choice([32, 40])).upper(), of(mixed, rng.randint(20, 48)), f"sk_live_{of(mixed, 24)}", f"{of(mixed, 10)}-{of(mixed, 12)}-{of(mixed, 9)}", f"AK{of(mixed.upper(), 18)}"])
        quote = rng.choice(['"', '"', "'", ""])
        lead = rng.choice(["token", "key", "secret", "password", "api key", "apikey", "TOKEN", "access_token"]) + rng.choice([" = ", "=", ": ", " "])
        head = f"{w()} {lead}{quote}"
        return f"{head}{s}{quote} {w()}", (len(head), len(head) + len(s), kind)
    elif rng.random() < 0.35:
        s = rng.choice([of(hexa, 40), of(hexa, 32), of(hexa, 64), "-".join(of(hexa, n) for n in (8, 4, 4, 4, 12)), w() + w() + w() + d(2), f"{w()}-{w()}-{w()}-{d(4)}", f"{w()}/{w()}/{d(4)}/{w()}{d(2)}", f"{w()}_{w()}_{w()}{d(1)}", w() * 4, f"{d(3)}[.]{d(2)}", of(mixed, 30), f"9{d(2)}[.]8{d(2)}[.]7{d(2)}[.]6{d(2)}"])
        lead = rng.choice(["sha ", "commit ", "md5 ", "digest ", "uuid ", "etag ", w() + " ", w() + " ", "version "])
    else:
        s = rng.choice([d(rng.randint(7, 13)), d(16), f"20{d(2)}-{d(2)}-{d(2)} {d(2)}", f"{d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}", f"{d(4)} {d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(3)}", f"{d(4)}/{d(2)}/{d(2)}", f"{w()} at {w()} dot", f"{w()} at {w()}. {w()}", f"{d(1)}.{d(3)}.{d(3)}", f"{d(5)}-{d(4)}", f"{d(6)} {d(6)} {d(6)}", f"{w()} at {w()} dot {w()}", f"{d(4)} {d(4)} {d(4)} {d(4)}"])
        lead = rng.choice(["isbn ", "order ", "ref ", "version ", "date ", w() + " ", w() + " "])
    head = f"{w()} {lead}"
    return f"{head}{s} {w()}", (len(head), len(head) + len(s), kind) if kind else None


@lru_cache(maxsize=2)
def trained(seed: int = 5, sentences: int = 900, epochs: int = 12, ridge: float = 1e-3) -> dict:
    """Weights by gradient ascent on the likelihood of invented sentences (fixed number, no input is read)."""
    rng, weights, square = random.Random(seed), defaultdict(float), defaultdict(lambda: 1e-6)
    data = [(t, gold) for t, gold in (_made(rng) for _ in range(sentences))]
    for _ in range(epochs):
        for text, gold in data:
            base = base_spans(text)
            for lo, hi in _windows(text, base):
                ends, by_end = _lattice(text, lo, hi, weights)
                n = len(ends)
                fwd = [0.0] * n
                for k in range(1, n):
                    xs = [fwd[k - 1], *(fwd[a] + s for a, _, _, s in by_end[k])]
                    top = max(xs)
                    fwd[k] = top + math.log(sum(math.exp(x - top) for x in xs))
                bwd = [0.0] * n
                starts = defaultdict(list)
                for k in by_end:
                    for a, _, _, s in by_end[k]:
                        starts[a].append((k, s))
                for k in range(n - 2, -1, -1):
                    xs = [bwd[k + 1], *(bwd[j] + s for j, s in starts[k])]
                    top = max(xs)
                    bwd[k] = top + math.log(sum(math.exp(x - top) for x in xs))
                grad: dict = defaultdict(float)
                for k in by_end:
                    for a, kind, feats, s in by_end[k]:
                        g = (gold is not None and (ends[a], ends[k], kind) == gold) - math.exp(fwd[a] + s + bwd[k] - fwd[-1])
                        for f in feats:
                            grad[f] += g
                for f, g in grad.items():
                    g -= ridge * weights[f]
                    square[f] += g * g
                    weights[f] += 0.3 * g / math.sqrt(square[f])
    return {k: v for k, v in weights.items() if abs(v) > 1e-6}


def added_spans(text: str, base: list[tuple[int, int, int]], weights: dict) -> list[tuple[int, int, int]]:
    return [x for lo, hi in _windows(text, base) for x in decode(text, lo, hi, weights)]


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{i}:{j}" for i, k, j in spans)


def _find(weights: dict):
    def run(batches):
        for b in batches:
            counts, digests, spans, many = [[] for _ in KINDS], [], [], []
            for text in b.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, weights) if text else []
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(rendered(base).encode()).hexdigest())
                spans.append(rendered(sorted(base + more)))
                many.append(len(base) + len(more))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(many, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return run


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, all spans and n_spans (their number) of every whole text.

    The field adds what the base patterns miss: numbers in other forms, addresses written out, and secrets, which are the kind "secret".
    Null and empty texts have no spans; rows that repeat stay. No shuffle: each row by itself.
    """
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_find(trained()), f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long")


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in capitals and brackets; n_chars follows. Overlapping spans become one, named by the first."""
    weights = trained()

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for k, text in enumerate(texts):
                if text and (spans := (base := base_spans(text)) + added_spans(text, base, weights)):
                    out, done = [], 0
                    for i, kind, j in sorted(spans):
                        if i >= done:
                            out += [text[done:i], f"[{ALL_KINDS[kind].upper()}]"]
                        done = max(done, j)
                    texts[k] = "".join(out) + text[done:]
            b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, b.schema.field("text").type))
            if "n_chars" in b.schema.names:
                at = b.schema.get_field_index("n_chars")
                b = b.set_column(at, b.schema.field(at), pa.array([None if t is None else len(t) for t in texts], b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
