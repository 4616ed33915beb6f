"""Personal data: fixed patterns, and spans from a character BiLSTM-CRF.

The base patterns give e-mail addresses, IP addresses, card and phone numbers,
each kind leftmost and without overlaps; they are matched in linear time.  The
tagger is trained from labelled spans: texts composed of invented words, into
which personal data and look-alikes are put at known places.  It reads windows
of ``WINDOW`` characters that overlap by half, and neighbouring windows are
joined to runs: every character's scores come from the window where it lies
nearest the middle, and the best path is decoded once over a run of any length.
A run whose edge cuts a span is read on.

A tagged span is added only where no base span lies, and only if it fits its
kind: an at sign or a written-out one in an address, digits in the others.  What
is a secret is left to the tagger; only its length, blanks and bare numbers are
looked at.  Windows are read around anchors: digits, at signs, an assignment or a
key word before a value, and capitals inside a word.  Letters of one case without
any of these are a word, no secret; otherwise reading the anchors' windows finds
what reading all windows finds (a test compares the two on whole tables).

Blanks can't be in a secret, which the decoding of the chain is told, and a secret
or address of which a part was tagged is taken as the whole run of letters, digits,
``_`` and ``-`` (hexadecimal digits and colons) around it, so that none is masked in part.  The
weights are trained once and kept in the shared folder, by a digest of this
code, and each process holds them.

Defined results: null and empty texts have no spans; repeated rows get equal
results; overlapping tagged spans are reconciled to the disjoint ones of largest
weight, ties by the earlier end; texts are read whole, however long; a null id
stays null; an empty table gives no rows; other columns pass through ``redact``.
"""

from __future__ import annotations

import functools
import hashlib
import inspect
import io
import ipaddress
import random
import re
import string
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import crf
from threadloom.llm.common import bound_batches, map_batches, table
from threadloom.scratch import shared_root

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
WINDOW, STRIDE = 128, 64
#: Windows tagged at once.
BATCH = 256
#: Least probability of a tagged span, averaged over its characters.
SURE = 0.8
#: Inputs that no secret holds, and the score of a tag that can't be.
BLANKS, NEVER = (crf.OWN.index(" "), crf.OWN.index("\n"), crf.SPACE), np.float32(-1e4)
#: Least characters of a secret.
SHORT = 8
#: Training: batches, and windows in each.
STEPS, PER_STEP = 480, 32

# The patterns of the contract (fixed values); possessive repeats and the look-behind
# only keep a failing match from being tried again inside the same run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = r"[\[({<]\s{0,3}at\s{0,3}[\])}>]"
# before a value: an assignment whatever its name, or a key word in a sentence
_SET = r"(?<=[\w\"'])\s{0,3}[:=]\s{0,3}[\"']?(?=[^\s\"':=])"
_SAID = r"(?i:(?:pass(?:word|wd|phrase|code)?|pwd|token|secret|key|credentials?)\s{1,3}(?:is|was|are)\s{1,3}[\"']?)"
_ANCHOR = re.compile(rf"[0-9@]|(?i:{_AT})|{_SET}|{_SAID}|[a-z](?=[A-Z])")
_WRITTEN_AT, _BEFORE_VALUE = re.compile(rf"@|{_AT}", re.I), re.compile(rf"(?:{_SET}|{_SAID})")
_IN_SECRET, _IN_ADDRESS = frozenset(string.ascii_letters + string.digits + "_-"), frozenset(string.hexdigits + ":")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns, by kind."""
    out: dict[str, list[tuple[int, int]]] = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out["phone"].append(m.span())
    return out


# training texts with labelled spans


def _word(rng: random.Random) -> str:
    letters = rng.choice(("etaoinshrdlu", string.ascii_lowercase, "eaéèiouçêlmnrst", "enrischtüöäß"))
    word = "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 2, 3, 4, 5, 6, 8, 11))))
    style = rng.random()
    return word.capitalize() if style < 0.15 else word.upper() if style < 0.2 else word


def _plain(rng: random.Random) -> str:
    """Something with digits that is no personal data."""
    n = lambda a, b: rng.randint(a, b)
    return rng.choice(
        (
            lambda: str(n(0, 99)),
            lambda: str(n(1900, 2099)),
            lambda: f"{n(1, 12)}.",
            lambda: f"{n(0, 9)}.{n(0, 99)}",
            lambda: f"Version {n(1, 9)}.{n(0, 9)}.",
            lambda: f"v{n(0, 9)}.{n(0, 20)}.{n(0, 9)}",
            lambda: f"CC BY-NC {n(1, 4)}.0.",
            lambda: f"${n(1, 999)}.{n(10, 99)}",
            lambda: f"{n(0, 23)}:{n(10, 59)}",
            lambda: f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}",
            lambda: f"{n(1, 9)},{n(100, 999)},{n(100, 999)}",
            lambda: f"{n(1, 100)}%",
            lambda: f"{_word(rng)}{n(0, 99)}",
            lambda: f"@{_word(rng)}",
            lambda: f"#{n(1, 99999)}",
            lambda: "".join(rng.choice(string.digits) for _ in range(n(3, 8))),
            lambda: f"{_word(rng)}{rng.choice((': ', ' = ', '=', ' is '))}{_word(rng)}",
            lambda: f"{_word(rng)}{rng.choice((': ', ' = ', '='))}{n(0, 9999)}",
            lambda: f"{_spoken(rng)}{rng.choice((' is ', ': ', ' = ', ' '))}{_spoken(rng)}",
            lambda: _spoken(rng) + "".join(_spoken(rng).capitalize() for _ in range(n(1, 3))),
            lambda: f"https://{_spoken(rng)}.{_spoken(rng)}.com/{_spoken(rng)}/{n(1, 9999)}",
            lambda: "-".join(_spoken(rng) for _ in range(n(2, 4))),
            lambda: f"{_spoken(rng)}_{_spoken(rng)}{n(0, 99)}",
            lambda: f"{rng.choice(NAMED)}{rng.choice((' is ', ' was ', ' for ', ': '))}{rng.choice(('the', 'a', 'not', _spoken(rng)))} {_word(rng)}",
        )
    )()


#: Names that training puts before secrets.
NAMED = ("password", "token", "secret", "api_key", "passwd", "access_token", "Password", "key", "credentials", "auth", "pwd", "PASSWORD", "API key", "passphrase")
#: Syllables of words that could be said.
_STARTS, _ENDS = ("b", "c", "d", "f", "g", "l", "m", "n", "p", "r", "s", "t", "st", "tr", "pl", "ch", "sh"), ("a", "e", "i", "o", "an", "en", "in", "or", "al", "er", "ist", "ing")


def _spoken(rng: random.Random) -> str:
    return "".join(rng.choice(_STARTS) + rng.choice(_ENDS) for _ in range(rng.choice((1, 2, 2, 3, 3, 4, 6))))


def _private(rng: random.Random) -> tuple[str, str, str, str]:
    """(text before, span, text after, kind) of one piece of personal data."""
    digits = lambda k: "".join(rng.choice(string.digits) for _ in range(k))
    low = lambda a, b: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(a, b)))
    kind = rng.choice(KINDS + ("secret",))
    if kind == "email":
        user = rng.choice((low(2, 8), f"{low(2, 7)}.{digits(2)}", f"{low(1, 6)}_{low(2, 6)}", f"{low(2, 6)}{digits(3)}"))
        host, end = rng.choice((low(3, 9), f"mail{digits(1)}.{low(4, 8)}")), rng.choice(("com", "org", "net", "de"))
        if rng.random() < 0.3:
            at, dot = rng.choice(((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", ".")))
            if rng.random() < 0.2:
                at, dot = at.upper(), dot.upper()
            return "", f"{user}{at}{host.replace('.', dot)}{dot}{end}", "", kind
        return "", f"{user}@{host}.{end}", "", kind
    if kind == "ip":
        if rng.random() < 0.4:
            groups = [f"{rng.randrange(16 ** rng.randint(1, 4)):x}" for _ in range(8)]
            gap = rng.randint(1, 5)
            return "", ":".join(groups) if rng.random() < 0.4 else ":".join(groups[:gap]) + "::" + ":".join(groups[gap + 2 :]), "", kind
        return "", ".".join(str(rng.randint(0, 255)) for _ in range(4)), "", kind
    if kind == "card":
        sep = rng.choice(("", "", " ", "-"))
        return "", sep.join([rng.choice("3456") + digits(3), digits(4), digits(4), digits(4)]), "", kind
    if kind == "phone":
        area, a, b = digits(3), digits(3), digits(4)
        return "", rng.choice((f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+{digits(2)} {area} {a} {b}", f"+1-{area}-{a}-{b}")), "", kind
    long = rng.random() < 0.25
    mixed = lambda k: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(k))
    value = rng.choice(
        (
            "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((64, 80, 128, 200) if long else (16, 18, 20, 32, 40)))),
            mixed(rng.randint(41, 220) if long else rng.randint(14, 40)),
            mixed(rng.randint(8, 13)),
        )
    )
    if rng.random() < 0.25:
        return "", "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16)), "", kind
    if rng.random() < 0.2:  # a prefix that names the issuer
        sep = rng.choice("__-")
        value = low(2, 4) + sep + (low(3, 5) + sep if rng.random() < 0.5 else "") + mixed(rng.randint(16, 40))
        if rng.random() < 0.5:
            return "", value, "", kind
    elif rng.random() < 0.15:
        value = rng.choice((
            "".join(rng.choice(string.ascii_letters) for _ in range(rng.randint(41, 160) if long else rng.randint(14, 40))),
            "".join(low(2, 8).capitalize() for _ in range(rng.randint(3, 6))) + low(3, 5),
            low(16, 32),
        ))
    name = rng.choice(NAMED)
    before, after = rng.choice((("=", ""), (' = "', '"'), (": ", ""), ("='", "'"), (" = ", ""), (" is ", ""), ('": "', '"')))
    return f"{name}{before}", value, after, kind


def labelled(rng: random.Random, size: int) -> tuple[str, list[tuple[int, int, str]]]:
    """A text of at least ``size`` characters and its labelled spans."""
    out, length, spans = [], 0, []
    junk = rng.choice(("", "", "", "***", "!!", "mixed"))

    def put(piece: str) -> None:
        nonlocal length
        out.append(piece)
        length += len(piece)

    while length < size:
        draw = rng.random()
        if draw < 0.13:
            before, span, after, kind = _private(rng)
            put(before)
            spans.append((length, length + len(span), kind))
            put(span)
            put(after)
        else:
            put(_plain(rng) if draw < 0.2 else _word(rng))
        put(rng.choice(("***", "&&&", "###", "$$$", "%%%")) if junk == "mixed" else junk)
        put(rng.choice((" ", " ", " ", " ", " ", " ", ", ", ". ", ".\n", "\n")))
    return "".join(out), spans


def _tags(size: int, spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for start, end, kind in spans:
        tag = 1 + 2 * kinds.index(kind)
        tags[start:end] = tag + 1
        tags[start] = tag
    return tags


def train(texts: list[tuple[str, list[tuple[int, int, str]]]], kinds: tuple[str, ...] = KINDS, seed: int = 5) -> crf.Tagger:
    """A tagger from texts with labelled spans; texts are cut into windows."""
    x, y = [], []
    for text, spans in texts:
        tags, ids = _tags(len(text), spans, kinds), crf.inputs(text)
        for at in range(0, len(text) - WINDOW + 1, WINDOW):
            cut = tags[at : at + WINDOW].copy()
            if cut[0] and cut[0] % 2 == 0:  # a span that began before is begun anew
                cut[0] -= 1
            x.append(ids[at : at + WINDOW])
            y.append(cut)
    order = np.random.default_rng(seed).permutation(len(x))
    x, y = np.array(x)[order], np.array(y)[order]
    tagger = crf.Tagger(len(kinds), seed=seed)
    tagger.fit((x[i : i + PER_STEP].T, y[i : i + PER_STEP].T) for i in range(0, len(x) - PER_STEP + 1, PER_STEP))
    return tagger


@functools.cache
def default_tagger() -> crf.Tagger:
    """Trained once in a process, from composed texts with labelled spans."""
    rng = random.Random(11)
    return train([labelled(rng, 4 * WINDOW) for _ in range(STEPS * PER_STEP // 4)])


_HELD: dict[str, crf.Tagger] = {}


def stored_tagger(spark: SparkSession) -> crf.Tagger:
    """``default_tagger`` from the shared folder, where a task of the first process that asks leaves its weights."""
    code = inspect.getsource(crf) + inspect.getsource(inspect.getmodule(stored_tagger))
    name = hashlib.sha256(code.encode()).hexdigest()[:16]
    if name not in _HELD:
        root = f"{shared_root(spark)}/threadloom/models/pii-{name}"
        done = _finished(spark, root)
        if not done:  # a folder of its own for each attempt: nobody overwrites what another reads
            made = spark.range(1, numPartitions=1).mapInArrow(_fitted, "weights binary")
            made.write.parquet(f"{root}/{uuid.uuid4().hex}")
            done = _finished(spark, root)
        tagger = crf.Tagger(len(KINDS))
        with np.load(io.BytesIO(bytes(spark.read.schema("weights binary").parquet(done[0]).first()["weights"]))) as held:
            tagger.w = {key: held[key] for key in held.files}
        _HELD[name] = tagger
    return _HELD[name]


def _finished(spark: SparkSession, root: str) -> list[str]:
    """Folders below ``root`` whose weights are whole, in order of name."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def _fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trained weights as one row; in a task, as its arithmetic libraries are held to one thread."""
    for batch in batches:
        if batch.num_rows:
            out = io.BytesIO()
            np.savez(out, **default_tagger().w)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["weights"])


# tagging


def _fits(kind: str, text: str, a: int, b: int) -> bool:
    """Whether text[a:b] can be of the kind; all that can holds an anchor or follows one."""
    span = text[a:b]
    digits = _NOT_DIGIT.sub("", span)
    if kind == "email":
        return bool(_WRITTEN_AT.search(span)) and ("." in span or "dot" in span.lower())
    if kind == "ip":
        if ":" in span:
            return bool(digits) and sum(map(bool, span.split(":"))) > 2 and _is_ipv6(span)
        parts = span.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and not re.search(r"[^0-9+() .-]", span) and len(span) > len(digits)
    if len(span) < SHORT or re.search(r"\s", span) or len(digits) == len(span):
        return False
    return bool(_ANCHOR.search(span)) or any(m.end() == a for m in _BEFORE_VALUE.finditer(text, max(0, a - 24), a + 1))


def _is_ipv6(span: str) -> bool:
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def _whole(kind: str, text: str, a: int, b: int, held: list[tuple[int, int]]) -> tuple[int, int]:
    """The run of a secret's or an address's characters around text[a:b], up to the spans ``held``."""
    inside = _IN_SECRET if kind == "secret" else _IN_ADDRESS
    low = max((y for _, y in held if y <= a), default=0)
    high = min((x for x, _ in held if x >= b), default=len(text))
    while a > low and text[a - 1] in inside:
        a -= 1
    while b < high and text[b] in inside:
        b += 1
    return a, b


def _reconcile(found: dict[tuple[int, int, int], float]) -> list[tuple[int, int, int]]:
    """Disjoint spans with the largest sum of weights: interval scheduling by dynamic programming."""
    spans = sorted(found, key=lambda s: (s[1], s[0], s[2]))
    ends = np.array([s[1] for s in spans])
    best, took = [0.0], []
    for i, span in enumerate(spans):
        before = int(np.searchsorted(ends[:i], span[0], "right"))
        gain = best[before] + found[span]
        took.append(before if gain > best[i] else -1)
        best.append(max(gain, best[i]))
    out, i = [], len(spans)
    while i:
        if took[i - 1] >= 0:
            out.append(spans[i - 1])
            i = took[i - 1]
        else:
            i -= 1
    return out[::-1]


def tag(texts: list[str], tagger: crf.Tagger, sure: float = SURE, every: bool = False) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind number) of the spans that the tagger finds in each text; ``every``: reads all windows."""
    # the last window that is needed: one before reaches the end of the text
    last = [max(0, -(-len(text) // STRIDE) - 2) for text in texts]
    cells: list[set[int]] = []
    for number, text in enumerate(texts):
        near = {x // STRIDE for m in _ANCHOR.finditer(text) for x in (m.start(), m.end())}
        if every:
            near = set(range(-(-len(text) // STRIDE) + 1))
        cells.append({c for x in near for c in (x - 1, x) if 0 <= c <= last[number]})
    found: list[dict] = [{} for _ in texts]
    left = [number for number, some in enumerate(cells) if some]
    while left:
        runs: dict[int, list[tuple[int, int]]] = {}
        for number in left:
            found[number] = {}
            own = sorted(cells[number])
            first = 0
            for i in range(1, len(own) + 1):
                if i == len(own) or own[i] != own[i - 1] + 1:
                    runs.setdefault(i - first, []).append((number, own[first]))
                    first = i
        again = set()
        for size, some in runs.items():
            step = max(1, BATCH // size)
            for begin in range(0, len(some), step):
                again |= _tag_runs(texts, tagger, sure, some[begin : begin + step], size, found, cells, last)
        left = sorted(again)
    return [_reconcile(f) if f else [] for f in found]


def _run_scores(texts, tagger, runs, size: int) -> np.ndarray:
    """Scores (STRIDE * (size + 1), runs, tags) of runs (text, first window) of ``size`` windows."""
    rows = []
    barred = np.zeros(((size + 1) * STRIDE, len(runs)), bool)
    ended = np.zeros_like(barred)
    for place, (number, cell) in enumerate(runs):
        ids = crf.inputs(texts[number][cell * STRIDE : (cell + size + 1) * STRIDE])
        barred[: len(ids), place] = np.isin(ids, BLANKS)
        ended[len(ids) :, place] = True
        ids = np.append(ids, np.full((size + 1) * STRIDE - len(ids), crf.REST))
        rows += [ids[i * STRIDE : i * STRIDE + WINDOW] for i in range(size)]
    out = np.empty(((size + 1) * STRIDE, len(runs), tagger.tags), np.float32)
    margin = STRIDE // 2
    for begin in range(0, len(rows), BATCH):
        scores, _ = tagger.scores(np.array(rows[begin : begin + BATCH]).T)
        for k in range(scores.shape[1]):
            run, i = divmod(begin + k, size)
            lo = margin if i else 0
            hi = WINDOW - margin if i < size - 1 else WINDOW
            out[i * STRIDE + lo : i * STRIDE + hi, run] = scores[lo:hi, k]
    # no secret holds a blank, and no span goes beyond the text
    secret = 1 + 2 * KINDS.index("secret")
    out[barred, secret : secret + 2] = NEVER
    out[ended, 1:] = NEVER
    return out


def _tag_runs(texts, tagger, sure, runs, size: int, found, cells, last) -> set[int]:
    """Adds the spans of the runs to ``found``; returns texts with cut spans, whose ``cells`` were extended."""
    again = set()
    scores = _run_scores(texts, tagger, runs, size)
    paths = tagger.decode(scores)
    some = np.flatnonzero(paths.any(axis=0))
    if not len(some):
        return again
    chance = tagger.marginals(scores[:, some])
    for place, b in enumerate(some):
        number, cell = runs[b]
        at, path = cell * STRIDE, paths[:, b]
        held = min(len(path), len(texts[number]) - at)
        for t in np.flatnonzero(path[:held] % 2 == 1).tolist():
            kind = (int(path[t]) - 1) // 2
            inside = path[t + 1 : held] == path[t] + 1
            end = held if inside.all() else t + 1 + int(inside.argmin())
            if t == 0 and at > 0:
                cells[number].update(range(max(0, cell - size), cell))
                again.add(number)
            if end == held and at + held < len(texts[number]):
                cells[number].update(range(cell + size, min(last[number], cell + 2 * size - 1) + 1))
                again.add(number)
            p = float(chance[np.arange(t, end), place, path[t:end]].mean())
            if p >= sure:
                found[number][(at + t, at + end, kind)] = p * (end - t)
    return again


def find(texts: list[str | None], tagger: crf.Tagger, every: bool = False) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """For each text its base spans, and all spans as (kind, start, end) in order of kind and start."""
    texts = [t or "" for t in texts]
    out = []
    for text, tagged in zip(texts, tag(texts, tagger, every=every)):
        base = base_spans(text)
        spans = [(kind, a, b) for kind in BASE_KINDS for a, b in base[kind]]
        held = [(a, b) for _, a, b in spans]
        for a, b, k in tagged:
            kind = KINDS[k]
            if any(a < y and x < b for x, y in held):
                continue
            if kind == "secret" or kind == "ip" and ":" in text[a:b]:
                a, b = _whole(kind, text, a, b, held)
                if kind == "secret" and _is_ipv6(text[slice(*_whole("ip", text, a, b, held))]):
                    kind, (a, b) = "ip", _whole("ip", text, a, b, held)
            if _fits(kind, text, a, b):
                spans.append((kind, a, b))
                held.append((a, b))  # a run of which two parts were tagged is one span
        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((base, spans))
    return out


def _written(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are masked as one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: crf.Tagger | None = None, text: str = "text") -> DataFrame:
    """``docs`` with personal data masked in ``text``; a null text stays null."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tagger or stored_tagger(docs.sparkSession))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text).to_pylist()
        new = [t and masked(t, spans) for t, (_, spans) in zip(texts, find(texts, held.value))]
        return {c: new if c == text else batch.column(c) for c in names}

    return map_batches(docs, run, schema)


def op10_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every whole text."""
    bound_batches(spark)
    held = spark.sparkContext.broadcast(stored_tagger(spark))
    counts = [f"n_{kind}" for kind in BASE_KINDS]

    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column("doc_id"), "base_sha256": [], "spans": []} | {c: [] for c in counts}
        for base, spans in find(batch.column("text").to_pylist(), held.value):
            for kind in BASE_KINDS:
                out[f"n_{kind}"].append(len(base[kind]))
            own = _written((kind, a, b) for kind in BASE_KINDS for a, b in base[kind])
            out["base_sha256"].append(hashlib.sha256(own.encode()).hexdigest())
            out["spans"].append(_written(spans))
        return out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = ", ".join(f"{c} long" for c in counts)
    return map_batches(docs, run, f"doc_id long, {fields}, base_sha256 string, spans string")
