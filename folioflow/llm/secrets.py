"""Secret scans: fixed patterns, and a character convolutional network over candidates in their context.

Candidates, beside all matches of the base patterns, are the runs of 15 or more token characters that are no plain
word or number, the parts of them between ``/``, ``.``, ``=``, ``:``, the passwords of urls (``//user:password@``) and the
values that are assigned to a name of a secret. Each is cut out with its context as ``WIDTH`` characters, a long one as
windows at every ``STEP``; a network of one convolution, pooling by place and two layers in numpy scores all of them.
Base matches always stay; a candidate is reported as kind ``net`` if its calibrated score reaches the threshold, the
largest at which held-out labelled findings keep the asked recall. A run that reaches it is reported whole, else those
of its parts that do.

The network is trained when the operator first runs, on labelled findings generated by fixed rules: secrets of random
prefix, alphabet, length and grouping, and look-alikes (uuids, blobs, digests, paths, names, dates, numbers). Nothing is
learned from the table, so results don't depend on what else it holds.

Defined results: a null text is empty and has no findings; long texts are scanned whole and candidates of any length
are judged by the mean of their windows; overlapping findings of different kinds all stay, and runs are cut where base
matches cover them; repeated rows get the same result; an empty table gives an empty result; other columns are passed
on by ``with_findings``, and one named ``findings`` is replaced.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDINGS = "findings"
KINDS = ("assign", "access", "hex", "net")
#: Fixed patterns of the contract, with their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

LEAST_RUN = 15
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{15,}")
#: What may part a run, the password of a url, and what is assigned to a name of a secret.
PARTS = re.compile(r"[^/.=:]{15,}")
URL_PASSWORD = re.compile(r"//[^\s:/@]{1,64}:([^\s/@]{6,128})@")
NAMED = re.compile(r"""(?:pwd|pass[a-z]*|secret|token|key|auth[a-z]*|credentials?)["']?[\x20\t]{0,2}[:=][\x20\t]{0,2}["']?([^\s"'<>,;]{8,128})""", re.IGNORECASE | re.ASCII)
NAMES = (*WORDS, b"pwd", b"pass", b"key", b"auth", b"credential")
_RUN = bytes(97 if chr(b) in string.ascii_letters + string.digits + "+/_=.~-" else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
STEP, BATCH = 12, 4096
RECALL = 0.97
#: Lengths are told to the network in classes: up to 11, 15, 19, 23, 31, 39, 47, 63, 95, 127, 191, more.
LENGTHS = np.array([12, 16, 20, 24, 32, 40, 48, 64, 96, 128, 192])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    low = text.encode().translate(_LOWER)
    runs = low.translate(_RUN)
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"a" * LEAST_ACCESS in runs:
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return sorted(out)


def _telling(x: str) -> bool:
    """Whether a run can be a secret: no number, and no plain word unless it is longer than words are."""
    letters, digits = re.search("[A-Za-z]", x), re.search("[0-9]", x)
    return bool(letters and (digits or len(x) >= 24 or re.search("[a-z][A-Z]|[A-Z]{2,}[a-z]", x)))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Groups of candidates (start, end, length of the run): a run, or what base matches leave of it, and then its parts."""
    low = text.encode().translate(_LOWER)
    out: list[list[tuple[int, int, int]]] = []
    if b"//" in low and b"@" in low:
        out += [[(*m.span(1), m.end(1) - m.start(1))] for m in URL_PASSWORD.finditer(text)]
    spans = sorted((x, y) for x, _, y in base)
    if any(w in low for w in NAMES):
        ends = {y for _, y in spans}
        out += [[(*m.span(1), m.end(1) - m.start(1))] for m in NAMED.finditer(text) if m.end(1) not in ends]
    if b"a" * LEAST_RUN in low.translate(_RUN):
        i = 0
        for m in RUN.finditer(text):
            a, b = m.span()
            while i < len(spans) and spans[i][1] <= a:
                i += 1
            k, left = i, []
            while k < len(spans) and spans[k][0] < b:
                left.append((a, spans[k][0]))
                a, k = max(a, spans[k][1]), k + 1
            for a, b in (*left, (a, b)):
                b = a + len(text[a:b].rstrip(".")) if b > a else b
                if b - a >= LEAST_RUN and _telling(text[a:b]):
                    parts = [(a + x.start(), a + x.end(), b - a) for x in PARTS.finditer(text[a:b]) if x.end() - x.start() < b - a and _telling(x[0])]
                    out.append([(a, b, b - a), *parts])
    return out


def _codes() -> dict[str, int]:
    """Class of a character: each ASCII letter and digit, the punctuation of tokens, and four classes for the rest."""
    own = {c: k for k, c in enumerate(string.ascii_letters + string.digits + "+/_=-.:\"'@ ", start=4)}
    return own | {"\n": 2, "\t": 2}


CODES = _codes()
N_CODES = 4 + len(CODES)


#: The run before or after a candidate, a blank or line end between them or none, and how far it is looked for.
ABOVE, BELOW, REACH = re.compile(r"[A-Za-z0-9+/_=.~-]*\Z"), re.compile(r"[A-Za-z0-9+/_=.~-]*"), 200


def windows(text: str, a: int, b: int, run: int) -> Iterator[np.ndarray]:
    """Of a candidate, at every ``STEP`` characters if it is longer than ``INSIDE``: classes of 24 characters before, 48 inside and 8 after it; how many are inside, and the classes of the lengths of it, its run, and the runs before and after it."""
    above = ABOVE.search(text[max(0, a - REACH) : a].rstrip())
    below = BELOW.match(text[b : b + REACH].lstrip())
    sizes = np.searchsorted(LENGTHS, [b - a, run, len(above[0]), len(below[0])], "right")
    for x in range(a, b - INSIDE, STEP) if b - a > INSIDE else ():
        yield _window(text, x, x + INSIDE, sizes)
    yield _window(text, max(a, b - INSIDE), b, sizes)


def _window(text: str, a: int, b: int, sizes: np.ndarray) -> np.ndarray:
    x = text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + text[a:b].ljust(INSIDE, "\0") + text[b : b + AFTER].ljust(AFTER, "\0")
    return np.array([*(CODES.get(c, 0 if c == "\0" else 3 if c.isalpha() else 1) for c in x), b - a, *sizes], np.int64)


class Network:
    """Embedding (8) - convolution (width 5, 32 filters) - maximum before, in and after the candidate and mean in it, beside lengths - 24 units - logistic output."""

    E, K, C, H = 8, 5, 32, 24
    ZONES = (slice(0, BEFORE - 4), slice(BEFORE - 4, BEFORE + INSIDE), slice(BEFORE + INSIDE, WIDTH - 4))

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = 4 * self.C + 4 * (len(LENGTHS) + 1)
        shapes = {"emb": ((N_CODES, self.E), 0.4), "w": ((self.K * self.E, self.C), 0.2), "b": (self.C, 0.0), "v": ((n, self.H), 0.12), "d": (self.H, 0.0), "o": (self.H, 0.3), "c": (1, 0.0)}
        self.p = {k: (r.normal(0, x, shape) if x else np.zeros(shape)).astype(np.float32) for k, (shape, x) in shapes.items()}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.0

    def _forward(self, x: np.ndarray) -> dict:
        chars, inside, sizes = x[:, :WIDTH], x[:, WIDTH], x[:, WIDTH + 1 :]
        e = self.p["emb"][chars]
        col = np.lib.stride_tricks.sliding_window_view(e, self.K, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.K * self.E)
        a = np.maximum(col @ self.p["w"] + self.p["b"], 0)
        top = [a[:, z].argmax(1) + z.start for z in self.ZONES]
        own = (np.arange(a.shape[1]) >= BEFORE - 2) & (np.arange(a.shape[1]) < BEFORE - 2 + inside[:, None])
        share = (own / np.maximum(1, own.sum(1, keepdims=True))).astype(np.float32)
        known = np.eye(len(LENGTHS) + 1, dtype=np.float32)[sizes].reshape(len(x), -1)
        f = np.concatenate([*(np.take_along_axis(a, t[:, None], 1)[:, 0] for t in top), np.einsum("nl,nlc->nc", share, a), known], 1)
        h = np.maximum(f @ self.p["v"] + self.p["d"], 0)
        return {"chars": chars, "col": col, "a": a, "top": top, "share": share, "f": f, "h": h, "z": h @ self.p["o"] + self.p["c"][0]}

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._forward(x[i : i + 512])["z"] for i in range(0, len(x), 512))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -30, 30)))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        t = self._forward(x)
        col, a, f, h, n = t["col"], t["a"], t["f"], t["h"], len(x)
        dz = ((1 / (1 + np.exp(-np.clip(t["z"], -30, 30))) - y) / n).astype(np.float32)
        dh = dz[:, None] * self.p["o"] * (h > 0)
        df = dh @ self.p["v"].T
        da = t["share"][:, :, None] * df[:, None, 3 * self.C : 4 * self.C]
        for k, top in enumerate(t["top"]):
            da[np.arange(n)[:, None], top, np.arange(self.C)] += df[:, k * self.C : (k + 1) * self.C]
        da *= a > 0
        dcol = (da @ self.p["w"].T).reshape(n, a.shape[1], self.K, self.E)
        demb = np.zeros_like(self.p["emb"])
        for k in range(self.K):
            codes = t["chars"][:, k : k + a.shape[1]].ravel()
            for e in range(self.E):
                demb[:, e] += np.bincount(codes, dcol[:, :, k, e].ravel(), N_CODES)
        return {"emb": demb, "w": np.tensordot(col, da, ((0, 1), (0, 1))), "b": da.sum((0, 1)), "v": f.T @ dh, "d": dh.sum(0), "o": h.T @ dz, "c": np.array([dz.sum()])}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 9, batch: int = 64, rate: float = 0.005, seed: int = 7) -> Network:
        """Adam on four fifths; on the rest the scores are calibrated (Platt) and the threshold is set for the recall."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        held, train = order[: len(x) // 5], order[len(x) // 5 :]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            r.shuffle(train)
            for i in range(0, len(train), batch):
                t += 1
                now = np.float32(rate * (1 - t / (epochs * -(-len(train) // batch) + 1)))
                for k, g in self._gradients(x[train[i : i + batch]], y[train[i : i + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        z, yh = self.logits(x[held]), y[held]
        scale = float(np.abs(z).mean()) or 1.0
        a, b = 1.0, 0.0
        for _ in range(2000):  # slope and shift (Platt) by gradient steps, towards smoothed labels
            d = 1 / (1 + np.exp(-np.clip(a * z / scale + b, -30, 30))) - (0.02 + 0.96 * yh)
            a, b = a - 0.5 * float((d * z).mean()) / scale, b - 0.5 * float(d.mean())
        self.slope, self.shift = a / scale, b
        s = np.sort(self.scores(x[held])[yh > 0.5])
        self.threshold = float(s[int((1 - RECALL) * len(s))]) if len(s) else 1.0
        return self


#: Words of texts, names and paths, so that look-alikes are made of what people write.
STEMS = (
    "the and with from after before between under other people first never water light house number between great small world still found study learn plant cover earth "
    "abstract access account address admin array backup batch block browser buffer build cache category change channel class client cluster column command common config connection content control count "
    "create custom data database debug default delete device directory document download driver element engine error event example exception execute export factory field file filter format function generate get group "
    "handler hash header host http image import index input install interface item java key kernel language layer library line list load local lock log main manager map master max memory message method min model module monitor "
    "name network node null number object offset operation option order output package page param partition path pattern pointer policy process profile project property protocol proxy python query queue random range read record "
    "der die und nicht gesellschaft versicherung schiff fahrt recht schutz geschwindigkeit kraft zeug haft pflicht arbeit wirtschaft schule wasser fenster straße les des pour avec dans société travail maison los las para ciudad gobierno trabajo"
).split()
LOW, UP, DIG = string.ascii_lowercase, string.ascii_uppercase, string.digits


def generated_findings(n: int = 28_000, seed: int = 7) -> list[tuple[str, int, int, int, int]]:
    """Labelled findings by fixed rules: (text, start, end, length of the run, label); half are secrets, half look-alikes."""
    r = random.Random(seed)
    some = lambda chars, a, b=0: "".join(r.choices(chars, k=r.randint(a, max(a, b))))
    syllable = lambda: r.choice(("b c d f g h l m n p r s t v w st tr pr ch sh th br gr cl pl qu" + " " * 3).split(" ")) + r.choice("aeiouaeioueaiouioee") + r.choice(["", "", "n", "r", "s", "t", "l", "m", "nd", "st", "ck", "ng"])
    word = lambda: r.choice(STEMS) if r.random() < 0.6 else "".join(syllable() for _ in range(r.randint(1, 4)))
    words = lambda sep, a, b: sep.join(word() for _ in range(r.randint(a, b)))
    alphabets = (LOW + UP + DIG, LOW + UP + DIG, LOW + UP + DIG, LOW + DIG, UP + DIG, LOW + UP, LOW + UP + DIG + "+/", LOW + UP + DIG + "_-", LOW)

    def secret() -> str:
        chars = r.choice(alphabets)
        prefix = r.choice(("", "", "", some(LOW, 2, 6) + r.choice("_-"), some(LOW + UP, 2, 5), some(LOW, 2, 4) + "_" + some(LOW, 3, 5) + "_", some(LOW, 3, 5) + some(DIG, 1) + r.choice("_-")))
        kind = r.random()
        if kind < 0.12:  # groups of characters
            return prefix + r.choice("--_.").join(some(r.choice((chars, DIG)) if k else chars, 5, 24) for k in range(r.randint(2, 4), -1, -1))
        if kind < 0.2:  # signed tokens of three parts
            return "eyJ" + ".".join(some(LOW + UP + DIG + "_-", 20, 90) for _ in range(3))
        body = some(chars, max(24 if chars in (LOW, LOW + UP) else 15, 15 - len(prefix)), r.choice((20, 28, 40, 64, 88)))
        return prefix + body + ("=" * r.randint(0, 2) if "+" in chars else "")

    def password() -> str:
        return some(LOW + UP + DIG + "!#$%&*+-.?@^_~", 8, 24) if r.random() < 0.7 else word().title() + some(DIG, 1, 4) + some("!#$%&*?", 1, 2) + some(LOW + UP + DIG, 2, 6)

    hexes = lambda k: some(DIG + "abcdef", k)
    blob = lambda a, b: some(LOW + UP + DIG + "+/", a, b) + "=" * r.randint(0, 2)
    uuid = lambda: "-".join(map(hexes, (8, 4, 4, 4, 12)))
    others = (
        uuid, uuid, lambda: uuid().upper(), lambda: word() + r.choice("-_/") + uuid(), lambda: "/" + words("/", 1, 3) + "/" + uuid(),
        lambda: blob(120, 400), lambda: blob(120, 400), lambda: blob(64, 64) + r.choice("+/") + blob(60, 300), lambda: r.choice(("sha512-", "integrity=")) + blob(86, 86) + "==", lambda: "sha256-" + blob(43, 43) + "=", lambda: "sha384-" + blob(64, 64), lambda: r.choice(("sha256-", "sha384-", "sha512-", "sha1-", "md5-")) + blob(22, 86), lambda: some(LOW + UP + DIG + "+/", r.choice((60, 64, 72, 76))), lambda: some(LOW + UP + DIG + "+/", r.choice((60, 64, 72, 76))), lambda: "sha1-" + hexes(12) + "-" + hexes(8),
        lambda: words("-", 3, 7), lambda: words("-", 3, 6) + "-" + some(DIG, 1, 6), lambda: words("_", 2, 5) + "_v" + some(DIG, 1, 2), lambda: words("_", 3, 6).upper(), lambda: "/" + words("/", 2, 6) + r.choice(("", "/" + some(DIG, 1, 8), ".html", ".tar.gz")),
        lambda: "".join(word().title() for _ in range(r.randint(2, 6))) + some(DIG, 0, 3), lambda: word() + "".join(word().title() for _ in range(r.randint(2, 5))), lambda: "".join(word() for _ in range(r.randint(4, 9))), lambda: "".join(word() for _ in range(r.randint(3, 6))) + some(DIG, 1, 4),
        lambda: f"{r.randint(1950, 2040)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{some(DIG, 2)}" + r.choice(("0000Z", "5959.123Z", "1500-0800")), lambda: "ISBN" + "-".join(some(DIG, 3) for _ in range(4)), lambda: some(UP, 2, 4) + some(DIG, 14, 24), lambda: some(UP, 2, 4) + "-" + some(DIG, 4) + "-" + some(DIG, 5, 8), lambda: "v" + ".".join(some(DIG, 1, 3) for _ in range(3)) + "-" + word() + "." + some(DIG, 1, 3) + "+build." + some(DIG, 2, 6),
        lambda: "www." + word() + word() + "." + r.choice(("com", "org", "net")) + "/" + words("-", 1, 5) + "/" + some(DIG, 1, 7), lambda: words(".", 2, 4) + "." + word() + ".com", lambda: word() + "=" + word() + some(DIG, 1, 4) + "/" + word() + "=" + some(DIG, 1, 6), lambda: words("_", 1, 4) + "_" + some(DIG, 8) + r.choice((".pdf", ".csv", ".jpg", ".parquet")), lambda: r.choice("=-_~") * r.randint(10, 40) + word() + some(DIG, 1, 2), lambda: "10." + some(DIG, 4, 5) + "/" + words(".", 1, 3) + "." + some(DIG, 4, 8), lambda: some("ACGT", 20, 90) + some(DIG, 1), lambda: "/" + words("/", 2, 5) + "/" + words("_", 1, 3) + some(DIG, 1, 4) + "." + word(),
        lambda: "/" + words("/", 1, 3) + "/" + word() + some(DIG, 1) + "/" + words("/", 1, 2) + "/" + words("_", 1, 2) + "_" + some(DIG, 1, 2) + "." + some(LOW, 2, 3), lambda: words("", 3, 5).title(), lambda: word().title() + words("", 2, 5), lambda: words("_", 2, 4) + "_" + some(DIG, 1), lambda: words("_", 2, 4).upper() + "_" + some(DIG, 1), lambda: word() + some(DIG, 1) + "".join(word().title() for _ in range(r.randint(1, 4))), lambda: words(".", 2, 3) + "." + "".join(word().title() for _ in range(r.randint(2, 4))),
    )
    plain_values = (lambda: words("-", 2, 4), lambda: words(".", 2, 4) + "()", lambda: word() + word(), lambda: "os.environ[" + word().upper() + "]", lambda: "${" + words("_", 1, 3) + "}", lambda: "<" + words("-", 1, 3) + ">", lambda: some("*x.", 1) * r.randint(8, 14), lambda: some(DIG, 8, 12), lambda: word().title() + word() + r.choice(".!?"), lambda: words("_", 2, 4) + "(" + word() + ")")
    lead = ("key ", "key is ", "bearer ", "auth: ", "use ", "", "", "", "", "set to ", "=", "X-Key: ", '"', "(")
    plain = ("see ", "", "", "", "at ", "file ", "https://", "id ", "id: ", "version ", "from ", "use ", '"', "(", "data:image/png;base64,", "ref=", "key ", "commit ")
    names = ("pwd", "pass", "passphrase", "auth", "credential", "db_pass", "private_key", "client_key", "PWD", "auth_value")
    out = []
    for k in range(n):
        label = k % 2
        before = words(" ", 2, 6) + r.choice((" ", " ", "\n", ": "))
        kind, run = r.random(), None
        if not label and r.random() < 0.2:  # lines of wrapped blobs, and parts of long ones between slashes
            chars = LOW + UP + DIG + "+/"
            if r.random() < 0.5:
                width = r.choice((60, 64, 64, 72, 76, 76))
                body, above, below = some(chars, width), some(chars, width) + "\n", "\n" + some(chars, r.choice((width, r.randint(20, width))))
                lines = r.random()
                before, after = (before, below) if lines < 0.35 else (before + above, below) if lines < 0.65 else (before + above, r.choice("\n, .") + " " + words(" ", 1, 4))
            else:
                body, head, tail = some(LOW + UP + DIG + "+", 15, 60), some(chars, 0, 300), some(chars, 60, 300)
                before, after = before + r.choice(plain) + head + "/" * bool(head), "/" + tail
                run = len(head) + len(body) + len(tail)
            out.append((before + body + after, len(before), len(before) + len(body), run or len(body), 0))
            continue
        if kind < 0.12:  # values of named secrets, and plain values of such names
            before += r.choice(names) + r.choice(("=", ": ", " = ", '="'))
            body = (password() if r.random() < 0.6 else secret()) if label else r.choice(plain_values)()
        elif kind < 0.2:  # passwords of urls, and hosts with ports
            before += word() + "://" + word() + ":"
            body = password().replace("@", "") if label else r.choice((some(DIG, 6), word() + word(), "password", "<password>", words("-", 2, 3)))
        else:
            body = secret() if label else r.choice(others)()
            before += r.choice(lead if label else plain)
            if r.random() < 0.2:  # parts of longer runs, of both labels
                path = "/" + words("/", 2, 8) + "/"
                before, run = before + path, len(path) + len(body)
        after = r.choice((" ", "\n", '" ', ", ", ". ", "@" + word() if 0.12 <= kind < 0.2 else ") ")) + words(" ", 2, 4)
        out.append((before + body + after, len(before), len(before) + len(body), run or len(body), label))
    return out


def train(findings: list[tuple[str, int, int, int, int]]) -> Network:
    """A long finding counts as each of its windows."""
    rows = [(w, y) for t, a, b, run, y in findings for w in itertools.islice(windows(t, a, b, run), 8)]
    return Network().fit(np.stack([w for w, _ in rows]), np.array([y for _, y in rows], float))


@functools.cache
def network() -> Network:
    """The trained network, once for each process that starts the operator."""
    return train(generated_findings())


def scan(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int]]]:
    """Findings of each text: (start, kind, end), in order."""
    found = [base_spans(t) if t else [] for t in texts]
    asked = [(i, g) for i, t in enumerate(texts) if t for g in candidates(t, found[i])]
    flat = [(i, x) for i, g in asked for x in g]
    sums, seen = np.zeros(len(flat)), np.zeros(len(flat), np.int64)
    every = ((k, w) for k, (i, x) in enumerate(flat) for w in windows(texts[i], *x))
    while part := list(itertools.islice(every, BATCH)):
        np.add.at(sums, [k for k, _ in part], net.scores(np.stack([w for _, w in part])))
        np.add.at(seen, [k for k, _ in part], 1)
    mean, at = sums / np.maximum(1, seen), 0
    for i, group in asked:
        reached = [(a, 3, b) for (a, b, _), s in zip(group, mean[at : at + len(group)], strict=True) if s >= net.threshold]
        found[i] += reached[:1] if reached and reached[0][0] == group[0][0] and reached[0][2] == group[0][1] else reached
        at += len(group)
    return [sorted(set(f)) for f in found]


def with_findings(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``findings``: array of (start, kind, end) in code points, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("array<struct<start: int, kind: int, end: int>>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in scan(list(s), shared.value)], dtype=object)

    return docs.withColumn(FINDINGS, find(F.col(text)))


def redacted(docs: DataFrame, net: Network, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by a mask (overlapping ones by one), and ``n_chars`` to match."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for t, spans in zip(s, scan(list(s), shared.value), strict=True):
                end, parts = 0, []
                for a, _, b in spans:
                    if a >= end:
                        parts += [t[end:a], mask]
                    end = max(end, b)
                out.append("".join([*parts, t[end:]]) if spans else t)
            yield pd.Series(out, dtype=object)

    d = docs.withColumn("text", clean(F.col("text")))
    return d.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else d


def digest(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    d = with_findings(docs.select("doc_id", "text"), network())
    names = F.array(*map(F.lit, KINDS))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(FINDINGS, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(FINDINGS, lambda s: s["kind"] < 3)
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(write(base), 256).alias("base_sha256"), write(F.col(FINDINGS)).alias("spans"))
