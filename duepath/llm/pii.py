"""Personal data: fixed patterns, and further spans by a linear-chain conditional random field.

The patterns find emails, IP addresses, card numbers and phone numbers (``base_spans``). The field labels the words near
a digit, an ``@`` or a written at or dot (bare or bracketed, any case) by word shapes and neighbours; it is trained from the small table ``LABELLED`` by gradient ascent
and decoded by Viterbi over batches of word sequences in numpy. It adds what patterns miss, such as ``name (at) host``
or phone numbers without a plus sign; spans that touch a base span of any kind are left out, base spans always stay.

Offsets are code points, end exclusive. Kinds in order: email, ip, card, phone, then the field's crf_email, crf_ip,
crf_card, crf_phone. The n_ columns and base_sha256 are of the base spans.

Defined cases: null text counts as empty and has no spans; rows without doc_id and repeated rows keep a row each; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + tuple(f"crf_{k}" for k in BASE_KINDS)

# The patterns of the contract, written so that no start is tried twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]|(?<!\S)(?:at|dot)(?!\S)", re.I)
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, sorted."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


# The labelled table: {kind:text} marks a span, everything else is outside.
LABELLED = """write to {email:anna.berg at example dot org} before noon
contact {email:j.doe (at) mail.example.com} for details
my address is {email:info [at] shop [dot] net} as always
mail {email:support@localhost} or come by
send it to {email:sales @ example.com} please
please ask {email:kim_lee[at]firm.example.net} about it
meet me at 5 at the old mill
we sat at table 12 and at 9 we left
call {phone:555 123 4567} after lunch
phone {phone:(020) 7946 0958} or write
tel: {phone:030/1234567} in the morning
tel. {phone:0171-5550123} any time
mobile {phone:0044 20 7946 0018} works too
reach us on {phone:212-555-0147} today
fax {phone:(415) 555-2671} is slow
call {phone:1-800-555-0199} for free
host {ip:10.0.0.1:8080} does not answer
ping {ip:192.168.1.12/24} once more
the server {ip:172.16.254.1:443} is down
from {ip:[203.0.113.7]} at night
card {card:4111.1111.1111.1111} was refused
pay with {card:5500/0000/0000/0004} now
visa {card:4012-8888-8888-1881x} expired
card no {card:3782.822463.10005} is old
in 1999 there were 25 of them
version 2.10.3 came out on 12.05.2021
it cost 1,250.00 or 30 percent less
chapter 7 page 112 line 3
the years 1990-1995 and 2001-2004 were dry
about 3000000 people live there
order 4785380592391135$$$ was shipped
key = 24be64439e3e49cf46b2d7c90f3602a3
token 9f86d081884c7d659a2feaa0c55ad015 is stale
room 101 at 10:30 on 2024-01-15
id 1234567890123456789012 is internal
see section 4.2.1.7.9 for more
a ratio of 3/4 or 0.75 is enough
@home we say so and @work we do not
user @anna said it in 2020
build 20240115.3 failed twice
the score was 3-1 and then 4-2
isbn 978-3-16-148410-0 is a book
###152.143.123.131### was there
reach me via {email:jo at mail dot example dot org} thanks a lot
ask {email:Max.Lee (AT) firm (DOT) example (DOT) com} about it
or {email:a [at] b [dot] c [dot] net} for the rest
they looked at the dot on the wall at noon
he was born at home and lived at sea
the last dot at the end of it is red
put a dot on the map at the corner
we met at noon and at night again
the dot com boom was over by then
he looked at dot and she looked at him
a red dot at the top and a blue dot below
good at maths and bad at chess
at work or at home
at first it was at rest
point at the dot and click
dinner at eight at the dot cafe
AT LAST THEY CAME BACK AT DAWN
the connect the dots game at the fair
sold at cost or at a loss in the north
""".splitlines()

# Written addresses of the table: frames, local parts, and hosts, combined by turns.
_FRAMES = ("write to {email:%s} today", "%s is not it but {email:%s} is", "{email:%s}", "you can reach me at {email:%s} or call", "mail {email:%s} about the house", "i am {email:%s}", "contact: {email:%s} for more", "ask her, {email:%s} or him")
_LOCALS = ("anna", "tom dot smith", "j.doe", "kim-lee", "sales DOT north", "Max", "info", "a dot b dot c", "lena_k", "otto [dot] berg", "bob77", "Eva (dot) Lind", "a")
_HOSTS = ("example dot org", "firm dot co dot uk", "mail.example.com", "acme DOT net", "shop [dot] example [dot] de", "big-house dot com", "Uni (dot) edu", "web dot info", "corp.example", "north dot example dot io", "b [dot] x [dot] net", "y (dot) z (dot) com", "q dot org")
_ATS = ("at", "AT", "(at)", "at", "[at]", "At", "at", "[AT]")


def written_lines(n: int = 200) -> list[str]:
    """``n`` lines with a written address, every choice in turn; a bare at stands only before hosts with a written dot."""
    out = []
    for k in range(n):
        at = _ATS[k % len(_ATS)]
        host = _HOSTS[(k + k // 6) % len(_HOSTS)]
        if at.lower() == "at" and " " not in host:
            at = "(at)"
        address = f"{_LOCALS[(5 * k + k // 7) % len(_LOCALS)]} {at} {host}"
        frame = _FRAMES[(k + k // 3) % len(_FRAMES)]
        out.append(frame % (("this", address) if frame.count("%s") == 2 else address))
    return out


# Prose with the same cues and nothing to find: an at without a dot, a dot without an at, sentences that begin with one.
_PROSE = ("%s %s at %s %s.", "%s. At %s, %s %s at %s.", "%s at %s and %s. At %s %s", "at %s. %s at at %s", "%s %s, at %s. %s %s dot %s", "At %s %s %s at %s, at %s", "%s the dot %s at %s. %s", "%s at %s dot, %s %s", "%s-%s at %s (%s). At %s.", "at At %s At %s. At %s at. At %s", "%s at the dot %s", "nobody at %s knows dot %s %s")
_PLAIN = "ea onhe shndtion thble When ouha nden, eres ingly Rean stes orhan. la und wolke Berg maths once river, printers old Tower blue esre thonwh es de it us".split()


def plain_lines(n: int = 100) -> list[str]:
    out = []
    for k in range(n):
        frame = _PROSE[k % len(_PROSE)]
        out.append(frame % tuple(_PLAIN[(7 * k + 3 * j) % len(_PLAIN)] for j in range(frame.count("%s"))))
    return out


LABELLED += written_lines() + plain_lines()

_MARK = re.compile(r"\{(\w+):([^}]*)\}")
_CUES = {"at": "AT", "(at)": "AT", "[at]": "AT", "dot": "DOT", "[dot]": "DOT", "(dot)": "DOT", "@": "@", "call": "TEL", "phone": "TEL", "tel:": "TEL", "tel.": "TEL", "tel": "TEL", "mobile": "TEL", "fax": "TEL", "card": "CARD", "visa": "CARD", "mail": "MAIL", "email": "MAIL", "host": "HOST", "server": "HOST", "ping": "HOST"}
_CUES |= dict.fromkeys("the a an of on in and we he she it is was to for or by my me him her they this that with from no not noon home night work first last end all once".split(), "STOP")
_CUES |= dict.fromkeys("com org net edu gov info io uk de fr es it co us eu".split(), "TLD") | {"it": "STOP"}
_CLASS = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
_AT = re.compile(r"@|\S\s*[(\[]at[)\]]\s*\S|\sat\s", re.I)
_HOSTLIKE = re.compile(r"[^\W\d_]\.[^\W\d_]")
_RUN = re.compile(r"([aA0])\1+")


@lru_cache(maxsize=1 << 16)
def shape(word: str) -> str:
    """Letters a, capitals A, digits 0, runs of them once; long words keep their first 24 signs of shape."""
    return _RUN.sub(r"\1", word[:256].translate(_CLASS))[:24]


@lru_cache(maxsize=1 << 16)
def _own(word: str) -> tuple[str, ...]:
    digits = sum(c.isdigit() for c in word[:64])
    plain = word.lower()[:16]
    cue = _CUES.get(plain) or _CUES.get(plain.rstrip(".,;:!?")) or ("HOST." if _HOSTLIKE.search(word) else "-")
    signs = "".join(sorted({c for c in word[:64] if c in ".:/-()[]@$#%&*=+_,"}))
    return (f"s={shape(word)}", f"d={min(digits, 20)}", f"p={signs}", f"w={cue}", f"n={min(shape(word).count('0'), 6)}", f"l={min(len(word), 24) // 4}")


def features(words: list[str]) -> list[list[str]]:
    own = [_own(w) for w in words]
    out = []
    for k, mine in enumerate(own):
        row = ["bias", *mine]
        seen = {}
        for d in (-3, -2, -1, 1, 2, 3):
            there = own[k + d] if 0 <= k + d < len(words) else ("s=.", "d=.", "", "w=.")
            seen[d] = there[3][2:]
            row += [f"{d}{there[3]}"] + ([f"{d}{there[1]}"] if abs(d) <= 2 else []) + ([f"{d}{there[0]}"] if abs(d) == 1 else [])
        near = {d: [own[j][3][2:] for j in range(k + 1, min(k + 6, len(words)))] if d > 0 else [own[j][3][2:] for j in range(max(0, k - 6), k)] for d in (-1, 1)}
        row += [f"{side}{cue}{cue in near[d]},{mine[3][2:]}" for d, side in ((-1, "<"), (1, ">")) for cue in ("AT", "DOT", "HOST.")]
        # the cues around the word, in order: an at and a dot only together make an address
        row += [f"<{seen[-2]},{seen[-1]},{mine[3][2:]}", f"{mine[3][2:]},{seen[1]},{seen[2]}>", f"<{seen[-1]},{mine[3][2:]},{seen[1]}>", f"{mine[3][2:]},{seen[2]},{seen[3]}>>", f"<<{seen[-3]},{seen[-2]},{mine[3][2:]}"]
        out.append(row)
    return out


class Field:
    """Weights per feature and label and per pair of labels; label 0 is outside, k + 1 is BASE_KINDS[k]."""

    def __init__(self, index: dict[str, int], unary: np.ndarray, pair: np.ndarray):
        self.index, self.unary, self.pair = index, unary, pair

    def scores(self, words: list[str]) -> np.ndarray:
        index = self.index
        return np.stack([self.unary[[index[f] for f in row if f in index]].sum(0) for row in features(words)])

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The best labelling of each sequence, sequences of like length side by side."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda k: len(sequences[k]))
        for part in range(0, len(order), 2048):
            chosen = order[part : part + 2048]
            lengths = np.array([len(sequences[k]) for k in chosen])
            steps = int(lengths.max())
            emit = np.zeros((len(chosen), steps, self.pair.shape[0]))
            for i, k in enumerate(chosen):
                emit[i, : lengths[i]] = self.scores(sequences[k])
            best = emit[:, 0]
            back = np.zeros((len(chosen), steps, self.pair.shape[0]), np.int8)
            for t in range(1, steps):
                step = best[:, :, None] + self.pair
                back[:, t] = step.argmax(1)
                best = np.where((lengths > t)[:, None], step.max(1) + emit[:, t], best)
            label = best.argmax(1)
            path = np.zeros((len(chosen), steps), np.int8)
            for t in range(steps - 1, -1, -1):
                path[:, t] = label
                label = np.where(lengths > t, back[np.arange(len(chosen)), t, label], label)
            for i, k in enumerate(chosen):
                out[k] = path[i, : lengths[i]]
        return out


def parse(line: str) -> tuple[list[str], list[int]]:
    words, labels, at = [], [], 0
    for m in [*_MARK.finditer(line), None]:
        plain = line[at : m.start() if m else len(line)].split()
        words += plain
        labels += [0] * len(plain)
        if m:
            inner = m[2].split()
            words += inner
            labels += [BASE_KINDS.index(m[1]) + 1] * len(inner)
            at = m.end()
    return words, labels


@lru_cache(maxsize=1)
def production_field() -> "Field":
    return fit(LABELLED)


def fit(lines: list[str], rounds: int = 200, rate: float = 0.5, ridge: float = 0.02) -> Field:
    """Weights that maximise the penalised likelihood, by forward-backward and Adagrad."""
    data = [parse(line) for line in lines if line.strip()]
    rows = [features(words) for words, _ in data]
    index = {f: k for k, f in enumerate(sorted({f for row in rows for fs in row for f in fs}))}
    labels, none = len(BASE_KINDS) + 1, len(index)
    size = np.array([len(row) for row in rows])
    steps, most = int(size.max()), max(len(fs) for row in rows for fs in row)
    # all sequences side by side; the place ``none`` and what lies beyond an end count for nothing
    coded = np.full((len(rows), steps, most), none)
    gold = np.zeros((len(rows), steps), int)
    for i, (row, (_, marks)) in enumerate(zip(rows, data)):
        gold[i, : len(marks)] = marks
        for t, fs in enumerate(row):
            coded[i, t, : len(fs)] = [index[f] for f in fs]
    real = (np.arange(steps) < size[:, None]).astype(float)
    both = real[:, 1:] * real[:, :-1]
    hits = np.zeros((len(rows), steps, labels))
    hits[np.arange(len(rows))[:, None], np.arange(steps), gold] = 1
    hits *= real[:, :, None]
    pairs = np.einsum("sta,stb,st->ab", hits[:, :-1], hits[:, 1:], both)
    unary, pair = np.zeros((none + 1, labels)), np.zeros((labels, labels))
    sums = [np.full_like(unary, 1e-6), np.full_like(pair, 1e-6)]
    for _ in range(rounds):
        unary[none] = 0
        emit = unary[coded].sum(2)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, steps):
            step = emit[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + pair, 1)
            ahead[:, t] = np.where(real[:, t, None] > 0, step, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            step = np.logaddexp.reduce(pair + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None] > 0, step, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], 1)
        expected = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        g_unary = -ridge * unary
        np.add.at(g_unary, coded, (hits - expected)[:, :, None, :])
        joint = np.exp(ahead[:, :-1, :, None] + pair + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        g_pair = -ridge * pair + pairs - joint.sum((0, 1))
        for value, g, s in ((unary, g_unary, sums[0]), (pair, g_pair, sums[1])):
            s += g * g
            value += rate * g / np.sqrt(s)
    unary = unary[:none]
    return Field(index, unary, pair)


def _plausible(kind: int, text: str) -> bool:
    """Whether a span has what its label can't do without: an at inside, or so many digits."""
    digits = len(_DIGIT.findall(text))
    if kind == 0:
        return bool(_AT.search(text))
    return (4 <= digits <= 20, 12 <= digits <= 19, 7 <= digits <= 15)[kind - 1]


def sequences(text: str, reach: int = 4) -> Iterator[list[tuple[int, int]]]:
    """Word spans around words with a digit, an @ or a written at or dot, ``reach`` words to each side, within a line.
    Windows that meet are one, so an address runs on as long as its cue words do."""
    at = 0
    while True:
        hit = _TRIGGER.search(text, at)
        if not hit:
            return
        begin = text.rfind("\n", 0, hit.start()) + 1
        end = text.find("\n", hit.start())
        end = len(text) if end < 0 else end
        words = [m.span() for m in _WORD.finditer(text, begin, end)]
        marks = [k for k, (a, b) in enumerate(words) if _TRIGGER.search(text, a, b)]
        run: list[int] = []
        for k in marks:
            if run and k - run[-1] > 2 * reach + 1:
                yield words[max(0, run[0] - reach) : run[-1] + reach + 1]
                run = []
            run.append(k)
        if run:
            yield words[max(0, run[0] - reach) : run[-1] + reach + 1]
        at = end + 1


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """The field's spans of each text that touch no base span."""
    places = [(k, words) for k, text in enumerate(texts) for words in sequences(text)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for part in range(0, len(places), 8192):
        group = places[part : part + 8192]
        found = field.decode([[texts[k][a:b] for a, b in words] for k, words in group])
        for (k, words), labels in zip(group, found):
            t = 0
            while t < len(labels):
                kind, begin = int(labels[t]), t
                while t + 1 < len(labels) and labels[t + 1] == kind:
                    t += 1
                t += 1
                if kind:
                    start, end = words[begin][0], words[t - 1][1]
                    end -= len(texts[k][start:end]) - len(texts[k][start:end].rstrip(".,;:!?"))
                    if _plausible(kind - 1, texts[k][start:end]) and not any(s < end and start < e for s, _, e in base[k]):
                        out[k].append((start, kind + 3, end))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = field or production_field()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [t.as_py() or "" for t in batch.column("text")]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model)
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digest, pa.string()), pa.array([written(b + m) for b, m in zip(base, more)], pa.string()), pa.array([len(m) for m in more], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
