"""Secret scans: patterns, and a character convolutional network over every candidate.

Three patterns find the usual forms; what they find always counts. Beside them, every run of
``LEAST_CANDIDATE`` or more token characters with a digit and a letter is a candidate. Of a run that
holds findings of the patterns, each part of that length beside them is one, and the whole run if one
of them is cut out of a longer word (hex digits or an access key with letters or digits around). The network
sees a candidate with its surrounding context as characters, a long one in views of ``INSIDE``
characters that begin every ``STRIDE`` characters, of which the highest score counts: classes of characters, others inside the
candidate than around it, go through one convolution, a maximum and a mean over the positions, and a
logistic output.

Its convolution is trained here, in numpy, on findings generated by rule in public key formats and
harmless look-alikes, a fixed set. Its output layer is then fitted to these and to all labelled views
of the whole corpus, those of the patterns being secrets and those of candidates made of words and
short numbers only being harmless; copies of a text count once. All other candidates of the corpus
may be secrets that the patterns miss, so they have no label. Each Newton step adds up loss, gradient
and Hessian over all views on the cluster; the penalized loss is convex, so where it ends does not
depend on how the rows lie. The corpus weighs at most as much as the generated findings, however many
views it has, and both labels weigh the same. Contexts are blanked in
half of the copies, so that the shape itself is learned. A held-out part, a quarter of the findings
of the corpus and of the generated ones with all their views and copies, calibrates the scores (Platt
scaling, by the same sums). The threshold is the highest that keeps a recall of ``LEAST_RECALL`` on
each generated format that the patterns miss, over all that are held out.

Defined results: null and empty texts have no findings; repeated rows are scanned row by row; an
empty table is scanned with a network that has seen the generated findings only. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import apart, map_arrow, texts_of, whole_text, written

#: The usual forms, in the order of their names (fixed values).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NETWORK = "network"

LEAST_CANDIDATE = 16
LEAST_RECALL = 0.98
GENERATED = 1200
#: Generated runs that hold a key among other parts, or none.
GLUED = 600
BEFORE, INSIDE, AFTER = 16, 40, 8
#: Characters between the views of a long candidate, and views handled at once.
STRIDE, SCORED_VIEWS = 8, 2048
WIDTH, FILTERS = 5, 24
EPOCHS, BATCH, STEP = 8, 64, 3e-3
#: Passes over the views of the corpus at most, the gain below which they end, and the pull of the output layer to where it began.
PASSES, GAIN, RIDGE = 20, 1e-10, 1e-3
#: One finding in so many is held out.
HELD_OUT = 4
SEED = 7

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CANDIDATE)
#: Parts of candidates that are known to be harmless.
_PARTS = re.compile(r"[+/_.=-]+")
_PLAIN = re.compile(r"[A-Z]?[a-z]{0,14}[0-9]{0,4}|[A-Z]{2,12}[0-9]{0,4}|[0-9]{1,8}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")


def character_classes() -> np.ndarray:
    """The class of each code below 128; all others are class 1."""
    classes = np.full(128, 2, np.int64)
    groups = ["aeiou", "bcdf", "ghjklmnpqrstvwxyz", "AEIOU", "BCDF", "GHJKLMNPQRSTVWXYZ", "01", "23456789", "=", ":", "\"'", " ", "\n\t\r", "+/", "_", "-", ".", "@"]
    for number, group in enumerate(groups, 3):
        for c in group:
            classes[ord(c)] = number
    return classes


CLASSES = character_classes()
#: Classes around the candidate and, after them, inside.
ALL_CLASSES = 2 * (int(CLASSES.max()) + 1)
LENGTH = BEFORE + INSIDE + AFTER


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, in order of start and kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]


def clear_of(spans: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans that overlap none of ``base``, which is in order of its starts."""
    starts = [x for x, _, _ in base]
    furthest = list(accumulate((y for _, y, _ in base), max))
    return [(a, b) for a, b in spans if not (before := bisect_left(starts, b)) or furthest[before - 1] <= a]


def harmless(candidate: str) -> bool:
    """Whether a candidate consists of words and short numbers only."""
    return all(_PLAIN.fullmatch(part) for part in _PARTS.split(candidate))


def beside(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """All candidates: runs clear of ``base``, the parts of other runs beside it, and runs whose words it cuts."""
    found: list[tuple[int, int]] = []
    first = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while first < len(base) and base[first][1] <= start:
            first += 1
        at, cut, here, parts = start, False, first, []
        while here < len(base) and base[here][0] < end:
            a, b, kind = base[here]
            if b > start:
                parts.append((at, max(at, a)))
                at = max(at, b)
                cut |= kind != "assign" and ((a > start and text[a - 1].isalnum()) or (b < end and text[b].isalnum()))
            here += 1
        parts.append((at, end))
        if cut:
            parts.insert(0, (start, end))
        for a, b in parts:
            if b - a >= LEAST_CANDIDATE and _DIGIT.search(text, a, b) and _LETTER.search(text, a, b):
                found.append((a, b))
    return found


def views(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The whole span, or overlapping parts of a long one, the last at its end."""
    if end - start <= INSIDE:
        yield start, end
        return
    for a in range(start, end - INSIDE, STRIDE):
        yield a, a + INSIDE
    yield end - INSIDE, end


def codes(text: str, start: int, end: int) -> bytes:
    """A candidate, or a view of one, and its context as classes of characters; 0 where there is nothing.

    Of a span longer than a view, the beginning and the end are seen.
    """
    inside = text[start:end]
    if len(inside) > INSIDE:
        inside = inside[: INSIDE - 12] + inside[-12:]
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    half = ALL_CLASSES // 2
    of = lambda part, more: [(CLASSES[c] if (c := ord(x)) < 128 else 1) + more for x in part]
    row = [0] * (BEFORE - len(before)) + of(before, 0) + of(inside, half) + of(after, 0)
    return bytes(row + [0] * (LENGTH - len(row)))


@dataclass
class Network:
    """One convolution over character classes, maximum and mean over positions, logistic output."""

    kernel: np.ndarray  # width x classes x filters
    bias: np.ndarray
    weights: np.ndarray  # 2 * filters
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _convolved(self, rows: np.ndarray) -> np.ndarray:
        size = rows.shape[1] - WIDTH + 1
        out = np.broadcast_to(self.bias, (len(rows), size, len(self.bias))).copy()
        for i in range(WIDTH):
            out += self.kernel[i][rows[:, i : i + size]]
        return out

    def features(self, rows: np.ndarray) -> np.ndarray:
        """What the output layer sees of each view: maxima and means over the positions, and a one."""
        parts = [np.empty((0, 2 * len(self.bias) + 1))]
        for i in range(0, len(rows), 256):
            hidden = np.maximum(self._convolved(rows[i : i + 256]), 0)
            parts.append(np.concatenate([hidden.max(1), hidden.mean(1), np.ones((len(hidden), 1))], axis=1))
        return np.concatenate(parts)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ np.append(self.weights, self.offset)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(rows) + self.shift, -30, 30)))


def train(rows: np.ndarray, labels: np.ndarray, held: np.ndarray) -> Network:
    """A network fitted to the labelled views that are not held out."""
    random_numbers = np.random.default_rng(SEED)
    fit = np.flatnonzero(~held)
    filters = FILTERS
    parts = [
        random_numbers.normal(0, 0.3, (WIDTH, ALL_CLASSES, filters)),
        np.zeros(filters),
        random_numbers.normal(0, 0.3, 2 * filters),
        np.zeros(1),
    ]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    balance = np.where(labels, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3))
    steps = 0
    size = LENGTH - WIDTH + 1
    for _ in range(EPOCHS):
        for chosen in np.array_split(random_numbers.permutation(fit), max(1, len(fit) // BATCH)):
            steps += 1
            x = rows[chosen]
            network = Network(parts[0], parts[1], parts[2], parts[3][0])
            convolved = network._convolved(x)
            hidden = np.maximum(convolved, 0)
            top = hidden.argmax(1)
            features = np.concatenate([hidden.max(1), hidden.mean(1)], axis=1)
            p = 1 / (1 + np.exp(-np.clip(features @ parts[2] + parts[3][0], -30, 30)))
            error = (p - labels[chosen]) * balance[chosen] / len(chosen)
            back = error[:, None] * parts[2]
            grad = np.repeat(back[:, None, filters:] / size, size, axis=1)
            np.add.at(grad, (np.arange(len(x))[:, None], top, np.arange(filters)), back[:, :filters])
            grad *= convolved > 0
            flat = grad.reshape(-1, filters)
            kernel = np.empty_like(parts[0])
            for i in range(WIDTH):
                one_hot = np.zeros((len(flat), ALL_CLASSES))
                one_hot[np.arange(len(flat)), x[:, i : i + size].reshape(-1)] = 1
                kernel[i] = one_hot.T @ flat
            grads = [kernel, flat.sum(0), features.T @ error, np.array([error.sum()])]
            for p_, g, (m, v) in zip(parts, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= STEP * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return Network(parts[0], parts[1], parts[2], float(parts[3][0]))


def views_of(codes_of_rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes_of_rows), np.uint8).reshape(-1, LENGTH).astype(np.int64)


def blank(rows: np.ndarray) -> np.ndarray:
    """The views without their contexts."""
    return np.where(rows >= ALL_CLASSES // 2, rows, 0)


def logistic_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weighted sums of the logistic loss of the rows ``x`` at the coefficients ``at``, of its gradient and its Hessian, in one vector."""
    z = x @ at
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    hessian = (x * (weights * p * (1 - p))[:, None]).T @ x
    return np.concatenate([[(weights * (np.logaddexp(0, z) - y * z)).sum()], x.T @ (weights * (p - y)), hessian.reshape(-1)])


def newton(sums: Callable[[np.ndarray], np.ndarray], start: np.ndarray, ridge: float) -> np.ndarray:
    """The coefficients of least loss, plus half of ``ridge`` times the square of their distance from ``start``."""
    size = len(start)
    at, step, best = start, np.zeros(size), np.inf
    for _ in range(PASSES):
        total = sums(at + step)
        loss = total[0] + 0.5 * ridge * ((at + step - start) ** 2).sum()
        if loss > best + GAIN:
            step = step / 2
            continue
        at, gained, best = at + step, best - loss, loss
        if gained < GAIN:
            break
        hessian = total[1 + size :].reshape(size, size) + (ridge + 1e-9) * np.eye(size)
        step = -np.linalg.solve(hessian, total[1 : 1 + size] + ridge * (at - start))
    return at


def corpus_sums(views: DataFrame, sums: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``sums`` gives for views, labels and counts of ``corpus_findings``, added up on the cluster over all of them.

    Every task sends the sums of its views as one row, whose places are then added up; only the totals are collected.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            rows = views_of(batch.column(0).to_pylist())
            part = sums(rows, batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False).astype(float))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = map_arrow(views.select("codes", "label", "n"), task, "sums array<double>").select(F.posexplode("sums").alias("place", "part"))
    found = parts.groupBy("place").agg(F.sum("part").alias("total")).collect()
    return np.array([r["total"] for r in sorted(found, key=lambda r: r["place"])])


class Labelled:
    """Generated views held on the driver and views of the corpus left on the cluster, as one weighted set."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, views: DataFrame, counts: dict[int, int]):
        self.rows, self.labels, self.views = rows, labels.astype(float), views
        self.many = sum(counts.values()) > 0
        #: The corpus weighs at most as much as the generated views; its views count twice, with and without context.
        self.share = min(1.0, len(rows) / max(1, 2 * sum(counts.values())))
        self.masses = [(labels == k).sum() + 2 * self.share * counts.get(k, 0) for k in (0, 1)]

    def sums(self, network: Network, x_of: Callable[[np.ndarray], np.ndarray], targets: tuple[float, float], weights: tuple[float, float]) -> Callable[[np.ndarray], np.ndarray]:
        """``logistic_sums`` over the set, where a view has the target and the weight of its label."""
        of = lambda labels, pair: np.where(labels > 0, pair[1], pair[0])
        here, share = x_of(network.features(self.rows)), self.share

        def at(coefficients: np.ndarray) -> np.ndarray:
            total = logistic_sums(here, of(self.labels, targets), of(self.labels, weights), coefficients)
            if not self.many:
                return total

            def of_views(rows: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
                y, w = of(labels, targets), of(labels, weights) * counts * share
                return sum(logistic_sums(x_of(network.features(some)), y, w, coefficients) for some in (rows, blank(rows)))

            return total + corpus_sums(self.views, of_views)

        return at


def fit_output(network: Network, fit: Labelled) -> None:
    """The output layer that separates all labelled views best, both labels weighing the same."""
    weights = tuple(0.5 / max(m, 1.0) for m in fit.masses)
    found = newton(fit.sums(network, lambda x: x, (0.0, 1.0), weights), np.append(network.weights, network.offset), RIDGE)
    network.weights, network.offset = found[:-1], float(found[-1])


def calibrate(network: Network, held: Labelled, formats: np.ndarray) -> None:
    """Platt scaling over all held-out views, then the highest threshold with the recall asked for on each format."""
    if min(held.masses) <= 0:
        return
    no, yes = held.masses
    layer = np.append(network.weights, network.offset)
    x_of = lambda x: np.stack([x @ layer, np.ones(len(x))], axis=1)
    found = newton(held.sums(network, x_of, (1 / (no + 2), (yes + 1) / (yes + 2)), (1 / (no + yes),) * 2), np.array([1.0, 0.0]), 1e-6)
    network.slope, network.shift = float(found[0]), float(found[1])
    scores = network.probabilities(held.rows)
    each = [np.sort(scores[formats == f]) for f in np.unique(formats[formats >= 0])]
    network.threshold = min((float(x[int((1 - LEAST_RECALL) * len(x))]) for x in each), default=0.5)


def generated_findings(count: int = GENERATED) -> tuple[list[bytes], list[int]]:
    """Findings in public key formats, and look-alikes that are none."""
    rows, labels, _ = generated_formats(count)
    return rows, labels


def generated_formats(count: int = GENERATED) -> tuple[list[bytes], list[int], list[int]]:
    """Generated findings, their labels, and the formats of those that the patterns miss (others -1)."""
    r = random.Random(SEED)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    mixed, low, hexes = string.ascii_letters + string.digits, string.ascii_lowercase, "0123456789abcdef"
    word = lambda: some("etaoinshrdlu", r.randint(2, 9))
    secrets = [
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + some(mixed, 36),
        lambda: "sk_live_" + some(mixed, 24),
        lambda: "xoxb-" + some(string.digits, 11) + "-" + some(mixed, 24),
        lambda: "AIza" + some(mixed + "_-", 35),
        lambda: "eyJ" + some(mixed, 20) + ".eyJ" + some(mixed, 30) + "." + some(mixed + "_-", 43),
        lambda: some(mixed + "+/", 40),
        lambda: some(mixed, 32),
        lambda: some(hexes, r.choice((24, 32, 40, 64))),
    ]
    others = [
        lambda: f"{word()}.{r.randint(1, 99)}@{word()}{r.randint(1, 9)}.example.com".replace("@", "_"),
        lambda: f"{word()}_{word()}_{word()}_{r.randint(0, 999)}",
        lambda: f"{word()}-{word()}-{word()}{r.randint(0, 99)}",
        lambda: f"www.{word()}{r.randint(0, 99)}.example.org/{word()}/{word()}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.00.00Z",
        lambda: f"{word().capitalize()}{word().capitalize()}{word().capitalize()}{word().capitalize()}{r.randint(1, 9)}x",
        lambda: f"/usr/lib/{word()}/{word()}/{word()}{r.randint(1, 9)}.txt",
        lambda: f"mail{r.randint(1, 9)}.example.com",
        lambda: f"{word()}.{word()}.{word()}.{word()}.v{r.randint(1, 20)}.{r.randint(0, 9)}",
        lambda: "".join(word() for _ in range(3)) + some(string.digits, 2),
    ]
    rows, labels, formats = [], [], []
    for i in range(count):
        secret = i % 2
        chosen = r.choice(secrets if secret else others)
        token = chosen()
        context = r.choice([" ".join(word() for _ in range(3)) + " ", "", "key: ", f"{word()}=", 'auth="', "\n", f"{word()} "]) if secret or r.random() < 0.8 else "id: "
        text = context + token + r.choice([" " + word(), "", '"', "\n" + word(), ". "])
        rows.append(codes(text, len(context), len(context) + len(token)))
        labels.append(secret)
        formats.append(secrets.index(chosen) if secret and not base_findings(token) else -1)
    return rows, labels, formats


def glued_findings(count: int = GLUED) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """Views of long runs with their labels, formats and runs: paths and names with a key among them, and without.

    A view with most of a key is one of a secret. Views with a part of a key have no label and are left out.
    """
    r = random.Random(SEED + 1)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    mixed, low = string.ascii_letters + string.digits, string.ascii_lowercase
    keys = [
        lambda: "ghp_" + some(mixed, 36),
        lambda: "sk_live_" + some(mixed, 24),
        lambda: "xoxb-" + some(string.digits, 11) + "-" + some(mixed, 24),
        lambda: "AIza" + some(mixed + "_-", 35),
        lambda: "eyJ" + some(mixed, 20) + ".eyJ" + some(mixed, 30) + "." + some(mixed + "_-", 43),
        lambda: some(mixed + "+/", 40),
        lambda: some(mixed, 32),
    ]
    syllables = [c + v for c in "bcdfghjklmnprstvwz" for v in "aeiou"] + ["con", "tar", "ing", "set", "lat", "est", "pro", "git", "hub", "ion", "ers", "src", "lib"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    plain = [word, word, word, lambda: word().capitalize(), lambda: word().upper(), lambda: str(r.randint(0, 2030)), lambda: f"{word()}{r.randint(0, 99)}", lambda: f"v{r.randint(1, 20)}"]

    def path(parts: int) -> str:
        return "".join(r.choice(plain)() + r.choice("//__..--=") for _ in range(parts))

    rows, labels, formats, runs = [], [], [], []
    for i in range(count):
        chosen = r.randrange(len(keys)) if i % 2 else -1
        key = keys[chosen]() if i % 2 else ""
        head = path(r.randint(0, 8) if key else r.randint(5, 12))
        tail = r.choice("/.=-") + path(r.randint(0, 6)) + some(low, 3) if key and r.random() < 0.7 else ""
        context = r.choice(["", " ".join(word() for _ in range(3)) + " ", "see ", '"', "\n"])
        text = context + head + key + tail + r.choice(["", " " + word(), '"', "\n" + word()])
        start, end = len(context), len(context + head + key + tail)
        at = start + len(head)
        for a, b in views(start, end):
            inside = min(b, at + len(key)) - max(a, at)
            if not key or inside >= min(0.8 * len(key), 0.8 * INSIDE):
                rows.append(codes(text, a, b))
                labels.append(int(bool(key)))
                formats.append(chosen)
                runs.append(i)
    return rows, labels, formats, runs


def corpus_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """All labelled views of the corpus: whether held out, label, codes, and how many views of different texts or findings they are.

    Secrets are the findings of the patterns, and harmless views those of all other candidates made of words and
    short numbers.
    """

    def labelled(key: int, t: str) -> Iterator[tuple[int, int, int, bytes]]:
        base = base_findings(t)
        for a, b, _ in base:
            yield key, a, 1, codes(t, a, b)
        for a, b in clear_of(candidates(t), base):
            if harmless(t[a:b]):
                for v in views(a, b):
                    yield key, a, 0, codes(t, *v)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = chain.from_iterable(map(labelled, batch.column(0).to_pylist(), texts_of(batch, 1)))
            while rows := list(islice(every, SCORED_VIEWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["key", "start", "label", "codes"])

    texts = docs.select(F.xxhash64(whole_text(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("_text"))
    found = map_arrow(texts, task, "key long, start int, label int, codes binary").distinct()
    held = F.pmod(F.xxhash64("key", "start", "label"), F.lit(HELD_OUT)) == 0
    return found.groupBy(held.alias("held"), "label", "codes").agg(F.count(F.lit(1)).alias("n"))


def fitted(docs: DataFrame, text: str = "text") -> Network:
    """The network trained on generated findings and on all labelled ones of the corpus."""
    rows, labels, formats = generated_formats()
    owners = list(range(len(rows)))
    glued, with_key, inside, runs = glued_findings()
    # Keys inside runs are formats of their own.
    owners += [len(rows) + run for run in runs]
    rows, labels, formats = rows + glued, labels + with_key, formats + [f if f < 0 else f + 100 for f in inside]
    every = views_of(rows)
    every = np.concatenate([every, blank(every)])
    labels, formats, owners = (np.array(x + x) for x in (labels, formats, owners))
    count = int(owners.max()) + 1
    held = np.isin(owners, np.random.default_rng(SEED).permutation(count)[: count // HELD_OUT])
    network = train(every, labels, held)

    corpus = written(corpus_findings(docs, text), "labelled-views")
    counts = {(r["held"], r["label"]): r["n"] for r in corpus.groupBy("held", "label").agg(F.sum("n").alias("n")).collect()}
    part = lambda chosen, of: Labelled(every[of], labels[of], corpus.where(F.col("held") == chosen), {k: n for (h, k), n in counts.items() if h == chosen})
    fit_output(network, part(False, ~held))
    calibrate(network, part(True, held), formats[held])
    return network


def scored(text: str, spans: list[tuple[int, int]], network: Network) -> list[float]:
    """The highest probability of each span's views."""
    scores = np.zeros(len(spans))
    every = ((i, v) for i, (a, b) in enumerate(spans) for v in views(a, b))
    while some := list(islice(every, SCORED_VIEWS)):
        rows = views_of([codes(text, a, b) for _, (a, b) in some])
        np.maximum.at(scores, [i for i, _ in some], network.probabilities(rows))
    return scores.tolist()


def findings(text: str, network: Network) -> list[tuple[int, int, str, float]]:
    """All findings of a text with the network's probabilities, in order."""
    base = base_findings(text)
    rest = beside(text, base)
    if not base and not rest:
        return []
    spans = [(a, b) for a, b, _ in base] + rest
    scores = scored(text, spans, network)
    found = [(a, b, k, s) for (a, b, k), s in zip(base, scores)]
    found += [(a, b, NETWORK, s) for (a, b), s in zip(rest, scores[len(base) :]) if s >= network.threshold]
    order = [*KINDS, NETWORK]
    return sorted(found, key=lambda x: (x[0], order.index(x[2])))


FINDING = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scan_secrets(docs: DataFrame, network: Network, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """The kept columns of each row and the findings of its whole text."""
    keep = list(keep)
    schema = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "score": s} for a, b, k, s in findings(t, network)] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, FINDING)], names=[*keep, "findings"])

    rows = docs.select(F.col(f"`{text}`").alias(apart(keep)), *[F.col(f"`{k}`") for k in keep])
    return map_arrow(rows, task, f"{schema}findings array<struct<kind:string,start:int,end:int,score:double>>")


def redacted(text: str, found: list[tuple[int, int, str, float]]) -> str:
    """The text with a mark in place of each secret; overlapping findings are one."""
    out, at = [], 0
    for start, end, kind, _ in found:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced by marks; null texts stay null, all other columns as they are."""
    place = docs.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, findings(t, network)) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, task, docs.schema)


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document."""
    found = scan_secrets(docs, fitted(docs), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"] != NETWORK)
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
