"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans; regex, gazetteer and context labelers vote on each (+1, -1 or 0). Expectation-maximisation
over the counts of equal vote vectors (at most 3^7 per kind, whatever the corpus size) estimates how reliable each
labeler is; the posteriors train a logistic span classifier, and that classifier decides, as a column expression, on
every span that is not one of the four exact base kinds. Base spans always stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.llm.common import stage

BASE = ("email", "ip", "card", "phone")
ADDED = ("contact", "telephone", "identity", "account", "secret", "person")
KINDS = BASE + ADDED

# Possessive forms of the four base patterns: they match the same spans and never go back, so that a long run of
# letters or digits costs its length once. A local part starts at the start of its run or where a match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11}(?:[\x20-]?[0-9])*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

OTHER = "|".join(
    (
        r"(?i:passwords?|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9/+_-]{8,}+\"?",
        r"(?<![A-Za-z0-9])(?=[A-Z]{1,40}[0-9])[A-Z][A-Z0-9]{14,39}+(?![A-Za-z0-9])",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?[\[(](?i:at)[\])]\s?[A-Za-z0-9-]{1,63}"
        r"(?:\s?(?:[\[(](?i:dot)[\])]|\.)\s?[A-Za-z]{2,24})+",
        r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}\p{L}{1,30}+(?: \p{Lu}\p{L}{1,30}+)?",
    )
)

CUES = {
    "contact": "mail|contact|write|reach",
    "telephone": "phone|tel|call|mobile|fax|contact",
    "identity": "ssn|social|security|identity|passport|tax",
    "account": "iban|account|bank|konto|cuenta|compte",
    "secret": "key|token|secret|credential|password|login",
    "person": "name|contact|dear|signed|author",
    "email": "mail|contact|write",
    "ip": "ip|host|address|server",
    "card": "card|visa|pay|credit",
    "phone": "phone|tel|call|mobile|fax",
}
TOP_DOMAINS = "com|org|net|edu|gov|info|de|fr|es|uk|eu|io|it|nl|ch|at|us|mx"
KEY_PREFIXES = "AKIA|ASIA|ghp_|sk_|xox|AIza"
COUNTRIES = "DE|FR|ES|GB|IT|NL|CH|AT|BE|PT|PL|SE|DK|NO|FI|IE|LU"
LABELERS = ("shape", "checksum", "gazetteer", "cue", "against", "variety", "place")
LEFT, RIGHT = 40, 12
BIAS = -1.5


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _located(text: str, pattern: str, guard: str) -> str:
    """SQL for array<struct<start, end, value, before, after>> of all matches, code points from 0."""
    pieces, found = f"split({text}, {_sql(pattern)}, -1)", f"regexp_extract_all({text}, {_sql(pattern)}, 0)"
    empty = "CAST(array() AS array<struct<start:int,end:int,value:string,before:string,after:string>>)"
    return f"""CASE WHEN {guard} THEN aggregate(
      zip_with(zip_with({pieces}, {found}, (p, x) -> named_struct('p', p, 'x', x)), slice({pieces}, 2, 2147483647),
               (z, q) -> named_struct('p', z.p, 'x', z.x, 'q', q)),
      named_struct('at', 0, 'out', {empty}),
      (acc, z) -> CASE WHEN z.x IS NULL THEN acc ELSE named_struct(
        'at', acc.at + length(z.p) + length(z.x),
        'out', concat(acc.out, array(named_struct(
          'start', acc.at + length(z.p), 'end', acc.at + length(z.p) + length(z.x), 'value', z.x,
          'before', right(z.p, {LEFT}), 'after', left(coalesce(z.q, ''), {RIGHT}))))) END,
      acc -> acc.out) ELSE {empty} END"""


def _kept(spans: str, kind: str, condition: str) -> str:
    """SQL for the spans that meet a condition on ``s``, with their kind."""
    return f"""transform(filter({spans}, s -> {condition}), s -> named_struct('start', s.start, 'end', s.end,
      'kind', {kind}, 'value', s.value, 'before', s.before, 'after', s.after))"""


DIGITS = "regexp_replace(s.value, '[^0-9]', '')"


def base_spans(text: str) -> str:
    """SQL for the spans of the four base kinds, by start and then by kind."""
    parts = {
        "email": (EMAIL, f"{text} LIKE '%@%'", "true"),
        "ip": (
            IP,
            f"{text} RLIKE r'[0-9]\\.[0-9]'",
            "forall(split(s.value, r'\\.'), x -> try_cast(x AS double) <= 255)",
        ),
        "card": (
            CARD,
            f"{text} RLIKE r'[0-9][0-9\\x20-]{{10}}'",
            f"length({DIGITS}) BETWEEN 12 AND 19 AND luhn_check({DIGITS})",
        ),
        "phone": (PHONE, f"{text} LIKE '%+%'", f"length({DIGITS}) BETWEEN 9 AND 15"),
    }
    every = ", ".join(_kept(_located(text, p, g), f"'{k}'", c) for k, (p, g, c) in parts.items())
    return f"concat({every})"


def other_spans(text: str) -> str:
    """SQL for the spans that only the classifier can accept; the pattern that matched gives the kind."""
    kind = r"""CASE
      WHEN s.value RLIKE r'^(?i:pass|pwd|token|secret|api)' THEN 'secret'
      WHEN s.value RLIKE r'^(?:Mr|Mrs|Ms|Dr|Prof)[. ]' THEN 'person'
      WHEN s.value RLIKE r'[\[(](?i:at)[\])]' THEN 'contact'
      WHEN s.value RLIKE r'^[0-9]{3}-[0-9]{2}-[0-9]{4}$' THEN 'identity'
      WHEN s.value RLIKE r'^[(0-9]' THEN 'telephone'
      WHEN s.value RLIKE r'^[A-Z]{2}[0-9]{2}' THEN 'account' ELSE 'secret' END"""
    # cheap, and true wherever OTHER can match
    guard = (
        f"{text} RLIKE r'[0-9]{{3}}|[=:]|[\\[(](?i:at)[\\])]|(?:Mr|Ms|rs|Dr|rof)[. ]"
        f"|(?<![A-Za-z0-9])(?=[A-Z]{{1,40}}[0-9])[A-Z][A-Z0-9]{{14}}'"
    )
    return _kept(_located(text, OTHER, guard), kind, "true")


def _votes() -> str:
    """SQL for the votes on a span ``s``, in the order of LABELERS."""
    cue = " ".join(f"WHEN '{k}' THEN r'(?i)(?:{v})'" for k, v in CUES.items())
    shape = r"""CASE s.kind
      WHEN 'identity' THEN CASE WHEN s.value RLIKE r'^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)' THEN 1 ELSE -1 END
      WHEN 'telephone' THEN CASE WHEN s.value RLIKE r'^\(?[2-9]' THEN 1 ELSE -1 END
      WHEN 'account' THEN CASE WHEN length(s.value) BETWEEN 15 AND 34 THEN 1 ELSE -1 END
      WHEN 'secret' THEN CASE WHEN s.value RLIKE r'[0-9]' AND s.value RLIKE r'[A-Za-z]{2}' THEN 1 ELSE -1 END
      ELSE 1 END"""
    values = (
        shape,
        "CASE s.kind WHEN 'card' THEN 1 WHEN 'ip' THEN 1 WHEN 'telephone' THEN "
        "CASE WHEN length(regexp_replace(s.value, '[^0-9]', '')) = 10 THEN 1 ELSE -1 END ELSE 0 END",
        f"""CASE WHEN s.kind IN ('email', 'contact') THEN
             CASE WHEN s.value RLIKE r'(?i)[^a-z](?:{TOP_DOMAINS})$' THEN 1 ELSE -1 END
           WHEN s.kind = 'secret' THEN CASE WHEN s.value RLIKE r'(?:^|[^A-Za-z])(?:{KEY_PREFIXES})' THEN 1 ELSE 0 END
           WHEN s.kind = 'account' THEN CASE WHEN s.value RLIKE r'^(?:{COUNTRIES})' THEN 1 ELSE -1 END
           WHEN s.kind = 'person' THEN 1 ELSE 0 END""",
        f"""CASE WHEN s.before RLIKE (CASE s.kind {cue} END) OR s.value RLIKE r'^(?i:pass|pwd|token|secret|api).*[=:]'
             THEN 1 ELSE 0 END""",
        r"CASE WHEN s.before RLIKE r'(?i)(?:isbn|version|order|invoice|page|item|price|[$€£#/])\s*$' THEN -1 ELSE 0 END",
        "CASE WHEN size(array_distinct(split(s.value, ''))) >= 5 THEN 1 ELSE -1 END",
        r"CASE WHEN s.after RLIKE r'^[A-Za-z0-9]' OR s.before RLIKE r'[A-Za-z0-9]$' THEN -1 ELSE 0 END",
    )
    return f"array({', '.join(f'CAST({v} AS int)' for v in values)})"


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a span with these votes is personal, from labelers whose reliability is estimated together.

    Two classes; given the class, labelers vote independently, with smoothed probabilities per vote. A base kind is
    known to be positive. It starts from the majority vote.
    """
    keys = sorted(counts)
    if not keys:
        return {}
    votes = np.array([v for _, v in keys])
    n = np.array([counts[k] for k in keys], float)
    known = np.array([kind in BASE for kind, _ in keys])
    kinds = np.array([KINDS.index(kind) for kind, _ in keys])
    post = np.where(known, 1.0, 1 / (1 + np.exp(-(votes.sum(axis=1) - 0.5))))
    # what a labeler is trusted to do before any data: to be right more often than not
    belief = {1: np.array([[0.1, 0.3, 0.6], [0.3, 0.5, 0.2]]), 0: np.array([[0.1, 0.3, 0.6], [0.3, 0.5, 0.2]])}
    for _ in range(rounds):
        share = np.zeros((2, votes.shape[1], 3))
        for y, weight in ((1, post), (0, 1 - post)):
            for v in (-1, 0, 1):
                share[y, :, v + 1] = ((votes == v) * (n * weight)[:, None]).sum(axis=0)
            prior = belief[1][0] if y else belief[1][1]
            share[y] = (share[y] + 20 * prior) / (share[y].sum(axis=1, keepdims=True) + 20)
        prior = np.full(len(KINDS), 0.5)
        for k in np.unique(kinds):
            m = kinds == k
            prior[k] = ((n * post)[m].sum() + 2) / (n[m].sum() + 4)
        logit = np.log(prior[kinds]) - np.log1p(-prior[kinds])
        for j in range(votes.shape[1]):
            logit = logit + np.log(share[1, j, votes[:, j] + 1]) - np.log(share[0, j, votes[:, j] + 1])
        post = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(logit, -50, 50))))
    return dict(zip(keys, post.tolist()))


def span_classifier(
    counts: dict[tuple[str, tuple[int, ...]], int], posteriors: dict, rounds: int = 400
) -> tuple[list[float], float]:
    """Logistic weights (+1 and -1 votes of each labeler) and bias, fitted to the posteriors of all span kinds.

    The fit starts from and is drawn towards one vote, one point: where a corpus says nothing of a labeler, its
    votes count as they are, and a span needs more votes for it than against.
    """
    keys = sorted(counts)
    k = len(LABELERS)
    start = np.array([1.0] * k + [-1.0] * k)
    if not keys:
        return start.tolist(), BIAS
    votes = np.array([v for _, v in keys])
    x = np.concatenate([votes == 1, votes == -1], axis=1).astype(float)
    y = np.array([posteriors[k] for k in keys])
    n = np.sqrt(np.array([counts[k] for k in keys], float))
    n /= n.sum()
    w, b = start.copy(), BIAS
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = n * (p - y)
        w -= 2 * (x.T @ g + 0.02 * (w - start))
        b -= 2 * (g.sum() + 0.02 * (b - BIAS))
    return w.tolist(), float(b)


def find_personal_data(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``df`` (all but the text by default) and ``found``: the personal spans of the whole text.

    ``found`` is array<struct<start, end, kind, base, value, score>> by start, then kind as listed in KINDS; positions are code points,
    end exclusive. Base kinds are exact patterns. Added spans never overlap a base span. A null or empty text has
    none. The driver collects counts of vote vectors only: at most 3^7 for each of ten kinds. A column of the input
    that is named ``found``, in any case, is replaced.
    """
    names = [c for c in (df.columns if keep is None else keep) if c.lower() != "found" and (keep is not None or c != text)]
    body = "`_text`"
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    spans = rows.withColumn("_base", F.expr(base_spans(body))).withColumn("_other", F.expr(other_spans(body)))
    apart = "filter(_other, o -> NOT exists(_base, b -> o.start < b.end AND b.start < o.end))"
    found = stage(
        spans.select(
            *[F.col(f"`{c}`") for c in names],
            F.expr(f"""transform(concat(_base, {apart}), s -> named_struct('start', s.start, 'end', s.end, 'kind',
              s.kind, 'value', s.value, 'votes', {_votes()}))""").alias("_spans"),
        ),
        "spans",
    )
    counts = {
        (r.kind, tuple(r.votes)): r.n
        for r in found.select(F.explode("_spans").alias("s"))
        .groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    weights, bias = span_classifier(counts, estimate(counts))
    return found.select(*[F.col(f"`{c}`") for c in names], _decided(weights, bias).alias("found"))


def _decided(weights: list[float], bias: float) -> Column:
    k = len(LABELERS)
    number = lambda xs: f"array({', '.join(f'{x!r}D' for x in xs)})"
    score = f"""1 / (1 + exp(-({bias!r}D + aggregate(zip_with(s.votes, zip_with({number(weights[:k])}, {number(weights[k:])},
      (p, m) -> named_struct('p', p, 'm', m)), (v, w) -> CASE v WHEN 1 THEN w.p WHEN -1 THEN w.m ELSE 0D END), 0D, (a, x) -> a + x))))"""
    base = "', '".join(BASE)
    order = ", ".join(f"'{x}'" for x in KINDS)
    return F.expr(f"""transform(array_sort(filter(transform(_spans, s -> named_struct(
        'start', s.start, 'rank', array_position(array({order}), s.kind), 'end', s.end, 'kind', s.kind,
        'base', s.kind IN ('{base}'), 'value', s.value, 'score', CASE WHEN s.kind IN ('{base}') THEN 1D ELSE {score} END)),
        s -> s.base OR s.score >= 0.5)),
      s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'base', s.base, 'value', s.value, 'score', s.score))""")


def listed(found: str, condition: str = "true") -> str:
    """SQL for kind:start:end of the spans, comma-joined."""
    return f"""array_join(transform(filter({found}, s -> {condition}),
      s -> concat_ws(':', s.kind, CAST(s.start AS string), CAST(s.end AS string))), ',')"""


def masked(text: str, found: str) -> str:
    """SQL for the text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    return f"""aggregate({found}, named_struct('at', 0, 'out', ''), (acc, s) -> CASE
        WHEN s.start >= acc.at THEN named_struct('at', s.end, 'out', concat(acc.out, substring({text}, acc.at + 1, s.start - acc.at), '<', s.kind, '>'))
        ELSE named_struct('at', greatest(acc.at, s.end), 'out', acc.out) END,
      acc -> concat(acc.out, substring({text}, acc.at + 1, 2147483647)))"""


__all__ = ["BASE", "KINDS", "estimate", "find_personal_data", "listed", "masked", "span_classifier"]
