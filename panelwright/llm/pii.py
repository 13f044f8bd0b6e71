"""Personal data in texts by weak supervision.

Candidates are the matches of fixed patterns, the matches those patterns
reject, and looser forms.  Labelers (pattern, checksum, gazetteer, context,
surroundings) vote on each.  Expectation-maximisation over the counts of equal
vote patterns estimates how reliable every labeler is; its posteriors train a
logistic classifier of votes and shape, which decides on candidates that are
not base matches.  Only counts of patterns, a bounded number, meet at the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import frozen

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "edges")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its beginning only; the rest of the pattern cannot do with less of it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIDDEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}"
    r"(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,63}){1,8}", re.I | re.A,
)
_LOCAL_PHONE = re.compile(
    r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-]?|00[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
    r"(?![0-9A-Za-z-])", re.A
)
_RUN = re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])")
#: Fixed values of the gazetteers: top-level domains, first digits of card issuers, calling codes.
DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl pl eu ch at be se no dk fi us ca au".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "30", "36", "38")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49")
NEAR = {
    "email": re.compile(r"mail|contact|write|reach|address", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|client", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment", re.I),
    "phone": re.compile(r"phone|\btel\b|call|mobile|cell|\bfax\b|whatsapp", re.I),
}
AWAY = re.compile(r"version|release|build|section|chapter|isbn|issn|order|invoice|tracking|serial|\bid\b|\bno\.", re.I)
CONTEXT = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each ``@`` outwards, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, rank of the kind, end, whether it is a base match), base matches first."""
    found = []
    if "@" in text:
        found += [(s, 0, e, True) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        found.append((m.start(), 1, m.end(), all(map(_small, m[0].split(".")))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19:
                found.append((m.start(), 2, m.end(), len(digits) >= 14 and luhn(digits)))
            elif len(digits) > 19:  # numbers side by side, which the pattern takes as one
                found += [(r.start(), 2, r.end(), False) for r in _RUN.finditer(text, m.start(), m.end())]
    if "+" in text:
        for m in _PHONE.finditer(text):
            count = len(_digits(m[0]))
            if count <= 15:
                found.append((m.start(), 3, m.end(), count >= 10))
    low = text.lower() if "at)" in text or "at]" in text or "AT" in text else ""
    if "(at)" in low or "[at]" in low:
        found += [(m.start(), 0, m.end(), False) for m in _HIDDEN.finditer(text)]
    found += [(m.start(), 3, m.end(), False) for m in _LOCAL_PHONE.finditer(text)]
    base = [f for f in found if f[3]]
    covered = bytearray(len(text) if len(found) > len(base) else 0)
    out = sorted(base)
    for start, _, end, _ in base if covered else ():
        covered[start:end] = b"\1" * (end - start)
    for start, rank, end, _ in sorted((f for f in found if not f[3]), key=lambda f: (f[0], f[1], -f[2])):
        if covered.find(1, start, end) < 0:
            out.append((start, rank, end, False))
            covered[start:end] = b"\1" * (end - start)
    return out


def votes(text: str, start: int, rank: int, end: int, base: bool) -> tuple[str, str]:
    """A letter for each labeler (+ for, - against, 0 no vote), and the shape."""
    said, kind = text[start:end], KINDS[rank]
    digits = _digits(said)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 12]
    if kind == "email":
        last = re.split(r"[.\s)\]]", said)[-1].lower()
        check, known = "+" if last.isalpha() and len(last) >= 2 else "-", "+" if last in DOMAINS else "0"
    elif kind == "ip":
        parts = said.split(".")
        check = "+" if all(map(_small, parts)) else "-"
        known = "-" if parts[0].lstrip("0") in ("", "10", "127") or said.startswith("192.168.") else "+"
    elif kind == "card":
        check, known = "+" if luhn(digits) else "-", "+" if digits.startswith(ISSUERS) else "-"
    else:
        check = "+" if 10 <= len(digits) <= 15 else "-"
        known = "+" if said[0] in "+(" and digits.startswith(CALLING) or said[:2] == "00" else "0"
    around = "-" if AWAY.search(before[-16:]) else "+" if NEAR[kind].search(before) else "0"
    touches = (before[-1:].isalnum() or after[:1].isalnum()) and "-" or "+"
    marks = "".join(sorted(set(c for c in said if not c.isalnum()) & set(" -.()@[]")))
    return ("+" if base else "0") + check + known + around + touches, f"{min(len(said) // 8, 6)}{marks}"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spans = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            own = []
            for start, rank, end, base in candidates(text):
                vote, shape = votes(text, start, rank, end, base)
                own.append({
                    "start": start, "rank": rank, "end": end, "kind": KINDS[rank], "base": base,
                    "pattern": f"{KINDS[rank]}|{vote}|{shape}",
                })
            base = [s for s in own if s["base"]]
            counts.append([sum(s["rank"] == r for s in base) for r in range(len(KINDS))])
            said = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
            digests.append(hashlib.sha256(said.encode()).hexdigest())
            spans.append(own)
        arrays = [batch.column("id"), *[pa.array([c[r] for c in counts], pa.int64()) for r in range(len(KINDS))]]
        kind = pa.list_(pa.struct([
            ("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()),
            ("base", pa.bool_()), ("pattern", pa.string()),
        ]))
        arrays += [pa.array(digests, pa.string()), pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(arrays, ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "found"])


def estimate(codes: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior that each vote pattern is right, by expectation-maximisation.

    ``codes`` has a column per labeler with 0 (against), 1 (no vote), 2 (for);
    votes are independent given the truth, with rates of their own per labeler.
    """
    score = (codes == 2).sum(1) - 1.0 * (codes == 0).sum(1)
    right = np.clip(0.5 + 0.15 * score, 0.05, 0.95)
    for _ in range(rounds):
        logs = np.zeros((2, len(codes)))
        for side, chance in enumerate((1 - right, right)):
            mass = chance * weight
            logs[side] += np.log(mass.sum() + 1)
            for column in codes.T:
                rates = np.bincount(column, mass, 3) + np.array([[3.0, 1, 0.5], [0.5, 1, 3.0]])[side]
                logs[side] += np.log(rates / rates.sum())[column]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - right).max() < 1e-9:
            return new
        right = new
    return right


def classify(patterns: list[str], weight: np.ndarray, steps: int = 25) -> np.ndarray:
    """Probability of each pattern: a logistic model of kind, votes and shape, trained on the posteriors."""
    split = [p.split("|", 2) for p in patterns]
    kinds = np.array([k for k, _, _ in split])
    codes = np.array([["-0+".index(v) for v in vote] for _, vote, _ in split])
    target = np.zeros(len(patterns))
    for kind in KINDS:
        if (own := kinds == kind).any():
            target[own] = estimate(codes[own], weight[own])
    names = [
        [f"{kind}", f"{kind}:{shape[0]}", *[f"{kind}:{m}" for m in shape[1:]], *[f"{kind}:{i}{v}" for i, v in enumerate(vote)]]
        for kind, vote, shape in split
    ]
    index = {n: i for i, n in enumerate(sorted({n for own in names for n in own}))}
    x = np.zeros((len(patterns), len(index)))
    for i, own in enumerate(names):
        x[i, [index[n] for n in own]] = 1
    beta = np.zeros(len(index))
    mass = weight / weight.sum() * min(weight.sum(), 1e6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (mass * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
        beta += np.linalg.solve(curve, x.T @ (mass * (target - p)) - beta)
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per input row: key, counts and digest of the base spans, ``spans`` as text and ``found`` as structs.

    Base spans always stay; of the other candidates, those that touch no base
    span and that the classifier gives ``least`` or more.  A null text counts as
    empty and has no spans; repeated rows and null keys stay rows of their own;
    an empty table gives no rows.  Other columns are not looked at.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = (
        "id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, found array<struct<start:int,"
        "rank:int,end:int,kind:string,base:boolean,pattern:string>>"
    )
    found = frozen(rows.mapInArrow(_found, schema))
    counts = found.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().orderBy("pattern").collect()
    taken: list[str] = []
    if counts:
        patterns = [r["pattern"] for r in counts]
        chance = classify(patterns, np.array([float(r["count"]) for r in counts]))
        taken = [p for p, c in zip(patterns, chance) if c >= least and p.split("|")[1][0] != "+"]
    known = F.array(*[F.lit(p) for p in taken]).cast("array<string>")
    kept = F.array_sort(F.filter("found", lambda s: s["base"] | F.array_contains(known, s["pattern"])))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.withColumn("spans", kept).select(
        F.col("id").alias(key), *[f"n_{k}" for k in KINDS], "base_sha256", listed.alias("spans"),
        F.col("spans").alias("found"),
    )
