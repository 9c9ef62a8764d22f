"""Secret scan: patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frequent import sampled_texts

# Fixed values of the scan's rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = np.full(128, len(CLASSES), np.int64)
for _i, _c in enumerate(CLASSES):
    CODE[ord(_c)] = _i
START, STATES = len(CLASSES) + 1, len(CLASSES) + 2
SEPARATORS = 62  # the first number of + / _ = -
LEAST = 16
CUT = 6.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, leftmost and non-overlapping within a kind, short ones dropped."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if any(len(w) >= 32 for w in text.split()):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return found


def codes_of(token: str) -> np.ndarray:
    return CODE[np.frombuffer(token.encode("ascii"), np.uint8)]


def steps(codes: np.ndarray) -> np.ndarray:
    """The transitions of a token, from a start state, as numbers."""
    return np.concatenate([[START], codes[:-1]]) * STATES + codes


def cut_costs(run: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """What it costs to begin and to end at each place of a run: strictly, and with + / _ - at the ends as well."""
    codes = codes_of(run)
    apart = np.concatenate([[True], codes >= SEPARATORS, [True]])
    out = []
    for barred in (codes >= SEPARATORS, codes == CLASSES.index("=")):
        starts, ends = (np.where(barred, np.inf, np.where(a, 0.0, CUT)) for a in (apart[:-2], apart[2:]))
        out.append((np.append(starts, np.inf), np.append(np.inf, ends)))
    return out


@dataclass
class SecretModel:
    """Log-likelihood ratios of transitions, of each random-string chain to the ordinary one, and the accepting sum."""

    gains: np.ndarray
    threshold: float

    def stretch(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[float, int, int]:
        """The stretch of ``LEAST`` codes or more with the greatest sum of ratios under one chain: sum, start, end.

        ``starts`` and ``ends`` hold what it costs to begin or end at each place.
        """
        n, best = len(codes), (-np.inf, 0, 0)
        step, first = steps(codes), START * STATES + codes
        most = max(1, (1 << 19) // n)
        for k in range(0, len(self.gains), most):
            gains = self.gains[k : k + most]
            total = np.zeros((len(gains), n + 1))
            np.cumsum(gains[:, step], axis=1, out=total[:, 1:])
            # A separator that begins a stretch says nothing of it.
            low = total[:, 1:] - np.where(codes >= SEPARATORS, 0.0, gains[:, first]) + starts[:-1]
            low = low[:, : n - LEAST + 1]
            sums = total[:, LEAST:] - ends[LEAST:] - np.minimum.accumulate(low, axis=1)
            c, at = divmod(int(sums.argmax()), sums.shape[1])
            if sums[c, at] > best[0]:
                best = (float(sums[c, at]), int(low[c, : at + 1].argmin()), at + LEAST)
        return best

    def stretches(self, gains: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[float, int, int]]:
        """All stretches that one chain's sums call random, from left to right.

        Where a sum falls by the threshold from its peak, ordinary text lies between, and what follows is a stretch of
        its own: by the likelihood ratio, within random characters such a fall has a chance of exp(-threshold) a place.
        """
        total = np.concatenate([[0.0], np.cumsum(gains[steps(codes)])])
        low = (total[1:] - np.where(codes >= SEPARATORS, 0.0, gains[START * STATES + codes]) + starts[:-1]).tolist()
        total, high = total.tolist(), (total - ends).tolist()
        out, base, peak, least, begin, best = [], 0, 0.0, np.inf, 0, (-np.inf, 0, 0)
        for e in range(1, len(total)):
            s = e - LEAST
            if s >= base and low[s] < least:
                least, begin = low[s], s
            if high[e] - least > best[0]:
                best = (high[e] - least, begin, e)
            if total[e] > peak:
                peak = total[e]
            elif peak - total[e] > self.threshold:
                if best[0] > self.threshold:
                    out.append(best)
                base, peak, least, best = max(e - 2, best[2]), total[e], np.inf, (-np.inf, 0, 0)
        return out + [best] if best[0] > self.threshold else out

    def found(self, run: str) -> list[tuple[int, int]]:
        """The stretches of a run of candidate characters that the sums call random, the surest first where they overlap.

        A stretch begins and ends with a letter or digit; where none of ``LEAST`` characters does, with + / _ - too. To
        begin or end inside a word, not beside a separator or at an end of the run, takes ``CUT`` off the sum.
        """
        codes, costs, out = codes_of(run), cut_costs(run), []
        parts = [(0, len(run))]
        # The best stretch, where its sum nowhere falls so far, needs no walk; what lies beside it does.
        total, start, end = self.stretch(codes, *costs[0])
        if total > self.threshold:
            step = steps(codes[start:end])
            sums = np.cumsum(self.gains[max(range(len(self.gains)), key=lambda k: self.gains[k, step].sum()), step])
            if (np.maximum.accumulate(sums) - sums).max() <= self.threshold:
                out, parts = [(start, end)], [(0, start), (end, len(run))]
        for lo, hi in parts:
            if hi - lo < LEAST:
                continue
            part, cuts, taken = codes[lo:hi], [(a[lo : hi + 1], b[lo : hi + 1]) for a, b in costs], np.zeros(hi - lo, bool)
            if max(self.stretch(part, *c)[0] for c in cuts) <= self.threshold:
                continue
            for starts, ends in cuts:
                for _, start, end in sorted((x for g in self.gains for x in self.stretches(g, part, starts, ends)), reverse=True):
                    if not taken[start:end].any():
                        taken[start:end] = True
                        out.append((lo + start, lo + end))
        return sorted(out)

    def score(self, run: str) -> float:
        """The sum of a run's best stretch."""
        return max(self.stretch(codes_of(run), *c)[0] for c in cut_costs(run))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """The stretches of candidate runs that the sums call random, as (start, kind, end)."""
        if not any(len(w) >= LEAST for w in text.split()):
            return []
        return [(m.start() + start, 3, m.start() + end) for m in CANDIDATE.finditer(text) for start, end in self.found(m.group())]


def chain(samples: list[str], smoothing: float = 0.5) -> np.ndarray:
    """Log transition probabilities, smoothed towards the sample's own character frequencies and those towards even."""
    counts = np.zeros(STATES * STATES)
    for token in samples:
        np.add.at(counts, steps(codes_of(token)), 1)
    counts = counts.reshape(STATES, STATES)
    seen = (counts.sum(0) + smoothing) / (counts.sum() + smoothing * STATES)
    return np.log((counts + 20 * seen) / (counts.sum(1, keepdims=True) + 20)).ravel()


def random_strings(draw: random.Random, alphabet: str, n: int) -> list[str]:
    return ["".join(draw.choices(alphabet, k=draw.randint(16, 64))) for _ in range(n)]


def identifiers(draw: random.Random, words: list[str], n: int) -> list[str]:
    """Ordinary identifiers: words joined in the usual ways, some with numbers or dates."""
    out = []
    while len(out) < n:
        picked = [draw.choice(words) for _ in range(draw.randint(2, 5))]
        style = draw.randrange(6)
        if style == 0:
            name = "_".join(picked)
        elif style == 1:
            name = picked[0] + "".join(w.capitalize() for w in picked[1:])
        elif style == 2:
            name = "-".join(picked)
        elif style == 3:
            name = "/".join(picked)
        elif style == 4:
            name = "_".join(w.upper() for w in picked)
        else:
            name = "".join(picked)
        if draw.random() < 0.6:
            name += draw.choice(["_", "-", "", "/"]) + draw.choice([str(draw.randint(10, 99999)), f"20{draw.randint(10, 29)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}", f"v{draw.randint(10, 99)}"])
        name = re.sub(r"[^A-Za-z0-9+/_=-]", "", name)
        if len(name) >= 16:
            out.append(name)
    return out


def paths(draw: random.Random, words: list[str], n: int) -> list[str]:
    """Long ordinary runs: identifiers joined to paths, slugs and assignments."""
    names = identifiers(draw, words, n)
    return ["".join(x + draw.choice("/=-_+") for x in draw.choices(names, k=draw.randint(1, 5))) + draw.choice(names) for _ in range(n)]


def numbers(draw: random.Random, n: int) -> list[str]:
    """Long ordinary numbers: account and serial numbers, and times to a fraction of a second."""
    return [str(draw.randint(10**15, 10 ** draw.randint(16, 24))) if i % 2 else f"20{draw.randint(10, 29)}{draw.randint(1, 12):02}{draw.randint(1, 28):02}{draw.randint(0, 235959):06}{draw.randint(0, 999999):06}" for i in range(n)]


#: The labelled random strings' alphabets: with digits, and of letters alone.
ALPHABETS = (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase)

#: Words of ordinary identifiers where the sampled documents give none.
PLAIN = "user name value index count total first last item list map key data file path line text page view model table column result error request response server client session config option default handler manager service factory update create delete insert select order group number string object array buffer stream reader writer message event time date start end width height color style image button title content header footer section parent child node tree graph edge weight score rate limit offset batch sample train test build version release package module import export public private static final return about above account action active address after again agent all also amount any app archive article asset author available away back bank base before best between block blog board body book both box brand browse business call campaign card case catalog category center change channel chapter chart check city class clean clear click close cloud code collection comment common company compare complete component condition contact container context copy core country course cover current custom customer daily dashboard database day design detail device different direction directory display document domain download dream drive during early edit education email empty enable engine english entry example exchange external family fast feature feedback field filter find fish flag folder follow font form forward found free friend from full game general get global good green guide half hand hard have health help high history holder home hotel house how human information inside install instance integer internal internet invoice issue january job join jump jumps journal just keep kitchen know label language large later layout lazy learn left legal letter level library life light link little local location lock login logo long look love mail main make market master match media medium member memory menu method middle might minute mobile mode money month more morning most mother mountain music must need network never new news next night north note notice office online only open operation other over overview owner paper parameter partner password past patient payment people period person phone photo picture piece place plain plan player point policy popular position post power present preview price primary print process product profile program project property provider quality query quick quickly random range ready record recent reference region remote report research reset resource review right river road role room round rule run runs safe same save school science screen script search second secret security see sentence settings share shop short show side sign simple single site small social software sound source south special speed staff standard state station status step still stock storage store story street strong student study subject submit summary support switch system target task team template term than that the their theme then there these they thing this thumb through ticket today together tool topic town track trade traffic training travel type under unique unit until upload upper use various vendor video visit voice wait walk wall want watch water weather week welcome west what when where which while white whole wide window winter wish with without woman wonder wood word work world would write year young your zone brown fox dog and everything".split()


def fit_secrets(docs: DataFrame, sample_rows: int = 1000, sample_chars: int = 20_000, samples: int = 6000, seed: int = 7, false_rate: float = 0.0005) -> SecretModel:
    """Trains the chains on labelled samples: generated random strings of eight alphabets, three of them without
    digits, and ordinary identifiers, paths and long numbers. No other rule gates the candidates: what has 16 characters
    is judged by the chains, by the sum of a stretch's ratios wherever it lies in a run. Strings of digits alone come
    out as ordinary, as random digits and a serial number are alike.

    The identifiers' words come from ``sample_rows`` documents at most (those with the smallest hash of ``doc_id``, but
    for texts over ``sample_chars``; they are scanned whole like all others) and a short fixed list. The threshold is
    set on samples that the chains did not see, so that at most ``false_rate`` of ordinary ones pass, whether of all
    words, of the fixed list's alone, paths or numbers, and never below 0.15 a character of the shortest stretch. Null ids and texts are not sampled;
    empty tables leave the fixed list.
    """
    words = sorted({w for t in sampled_texts(docs, sample_rows, sample_chars) for w in re.findall(r"[A-Za-z]{3,12}", t)})
    draw = random.Random(seed)
    pool = PLAIN + draw.sample(words, min(len(words), len(PLAIN) * 3))
    plain = chain(identifiers(draw, pool, samples) + paths(draw, pool, samples // 6) + numbers(draw, samples // 6))
    model = SecretModel(np.array([chain(random_strings(draw, a, samples // 2)) - plain for a in ALPHABETS]), LEAST * 0.15)
    # A path holds four identifiers in the mean.
    for fresh in (identifiers(draw, pool, samples), identifiers(draw, PLAIN, samples), paths(draw, pool, samples // 4), numbers(draw, samples)):
        scores = sorted(map(model.score, fresh), reverse=True)
        model.threshold = max(model.threshold, scores[int(false_rate * samples)] + 0.5)
    return model


def rendered(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``), in one pass over whole texts without a shuffle.

    Returns ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_random`` (matches by kind), ``base`` (spans of the
    three patterns, as kind:start:end in code points, by start and kind) and ``spans`` (all spans). A random-looking
    string is added where it overlaps no base span. A null text is an empty one; repeated rows stay; nothing is dropped.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, 500):
                part = frame.slice(at, 500)
                ids, rows = part.column(0), []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    more = [s for s in model.spans(text or "") if all(s[2] <= b[0] or b[2] <= s[0] for b in base)]
                    rows.append((*(sum(b[1] == k for b in base) for k in range(3)), len(more), rendered(base), rendered(base + more)))
                columns = [pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base string, spans string")


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Scans all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_secrets(docs, fit_secrets(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")
