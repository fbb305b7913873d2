"""Personal data by weak supervision.

Base spans come from fixed rules (``base_spans``). Beyond them, loose patterns
propose candidates: other forms of the base kinds, secrets (keys, tokens,
passwords), account numbers, identity numbers, dates of birth, names after a title and
street addresses. Labelers of three sorts vote on each candidate, base spans
included (+1, -1 or no opinion):

* regex: checks of the candidate's own form, its checksum and how random it looks;
* gazetteer: known domains, card issuers, calling codes, countries, key prefixes;
* context: cue words of four languages before and after it.

Expectation-maximisation over the counts of vote patterns estimates, per kind,
how reliable each labeler is (``aggregate``); the posterior labels train a
logistic span classifier on hashed shapes, cues and votes (``fit``). ``detect``
adds the candidates that the classifier accepts; base spans always stay.

How it scales. ``fit`` reads all texts once: patterns are counted over all
candidates (at most 3 ** labelers rows a kind reach the driver, whatever the
input), and the classifier is fitted on the ``SAMPLE`` distinct candidates of each kind
with the smallest hash, each weighted by how often it occurs - a documented bound, chosen by
a top-k that keeps as many rows per task. Candidates that look alike to the classifier are
one row from the task that found them on, so copies of one number crowd out nothing.
``detect`` is one more pass with a model of fixed size; no shuffle. All
patterns run in time linear in the text: none can backtrack over a run twice.

Offsets count code points, ends are exclusive. A null or empty text has no
spans; repeated rows are handled one by one; an empty table trains a model that
adds nothing; input columns named like an output column are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop, new_dir, sliced, table

#: Kinds of base spans, then those that only the method finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account", "identity", "birth", "name", "address")
#: Distinct candidates of each kind that the classifier is fitted on; bounds what reaches the driver.
SAMPLE = 4_000
#: Hashed features of the classifier.
FEATURES = 1 << 12
#: Posterior from which a candidate is personal data.
ACCEPT = 0.5
#: Code points of context on either side.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order; failing matches are dropped without a retry."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


# Common endings of host names.
_ENDINGS = frozenset("com org net edu gov io co info de fr es uk it nl eu ch at us ca au jp br mx ar".split())
# First digits of the large card issuers.
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "30", "36", "38")
# Countries with standard account numbers, and how long these are.
_ACCOUNTS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
# What keys of widely used services begin with.
_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxb-", "xoxp-", "eyJ", "-----BEGIN")
# Cue words in English, German, French and Spanish.
_CUES = {
    0: "mail email e-mail contact write address adresse courriel correo kontakt schreiben escribir".split(),
    1: "ip host server address client login adresse serveur servidor rechner".split(),
    2: "card credit visa mastercard amex payment karte kreditkarte carte tarjeta paiement pago zahlung".split(),
    3: "phone tel telephone call mobile cell fax telefon anruf handy appeler portable telefono teléfono móvil llamar téléphone".split(),
    4: "token secret password passwd passphrase key apikey api credential credentials bearer auth login passwort kennwort schlüssel clé contraseña clave".split(),
    5: "iban account bank bic konto bankkonto compte banque cuenta banco".split(),
    6: "ssn social security passport identity ausweis reisepass passeport identité pasaporte identidad dni".split(),
    7: "born birth birthday dob geboren geburtstag geburtsdatum né née naissance nacido nacida nacimiento".split(),
    8: "name called named contact dear sincerely heißt gruß nom appelle nombre llama".split(),
    9: "address street lives resident ship deliver adresse wohnt habite dirección domicilio vive".split(),
}
_AGAINST = frozenset("version release isbn issn order invoice total page figure table section item id number build commit checksum sha md5 hash chapter seite page página tabla nr no".split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

_DIGITS = tuple("0123456789")
#: Kind, pattern (its last group, if any, is the span), and characters or words of which a text needs one.
_LOOSE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({](?:at|AT|@)[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?[\[({](?:dot|DOT|\.)[\])}] ?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+){1,4}"), ("[", "(", "{")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), (":",)),
    (2, re.compile(r"(?<![0-9.-])[0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{2,4}(?![0-9-])|(?<![0-9A-Za-z.-])[0-9]{13,19}(?![0-9A-Za-z-])"), _DIGITS),
    (3, re.compile(r"(?<![0-9+(-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])"), _DIGITS),
    (3, re.compile(r"(?<![0-9+])00[1-9][0-9]{0,2}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,4}(?![0-9-])"), ("00",)),
    (4, re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|(?:access|private)[_-]?key|credential)[A-Za-z0-9_-]{0,20}+[\"']?\s{0,3}+(?:=>|:=|[=:])\s{0,3}+[\"']?([^\s\"'<>,;]{8,}+)"), ("=", ":")),
    # Secrets are taken whole, however long: a part of one left in the text would still be read.
    (4, re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16,}+|gh[opusr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|xox[bp]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35,}+|(?<![_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"), _PREFIXES),
    # A private key goes to its end line; without one, through its headers and what follows in its alphabet.
    (4, re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:\s*+[A-Za-z-]++: [^\n]*+)*+[A-Za-z0-9+/=\s]*+)"), ("-----BEGIN",)),
    (4, re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"), _DIGITS),
    (5, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _DIGITS),
    (6, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ("-",)),
    (7, re.compile(r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[01]?[0-9]-[0-3]?[0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![0-9./-]?[0-9])"), ("19", "20")),
    (8, re.compile(r"(?<![^\W_])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sr|Sra)\.? ([A-ZÄÖÜÉÁÍÓÚÑ][a-zà-ÿ]{1,30}+(?: [A-ZÄÖÜÉÁÍÓÚÑ][a-zà-ÿ]{1,30}+){0,2})"), ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Sr")),
    (9, re.compile(r"(?<![0-9])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|Road|Avenue|Lane|Drive|Boulevard|Court|Square)(?![A-Za-z])"), ("Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "Court", "Square")),
    (9, re.compile(r"(?<![^\W_])[A-ZÄÖÜ][a-zäöüß]{2,30}(?:straße|strasse|weg|platz|gasse) [0-9]{1,4}[a-z]?(?![^\W_])"), ("straße ", "strasse ", "weg ", "platz ", "gasse ")),
    (9, re.compile(r"(?<![0-9])[0-9]{1,4},? (?:rue|avenue|boulevard|place) (?:(?:de|du|des|la|le) ){0,3}[A-ZÉ][a-zà-ÿ]{1,30}"), (" rue ", " avenue ", " boulevard ", " place ")),
    (9, re.compile(r"(?<![^\W_])(?:Calle|Avenida|Plaza|Paseo) (?:(?:de|del|la|los) ){0,3}[A-ZÁÉÍÓÚ][a-zà-ÿ]{1,30},? [0-9]{1,4}(?![0-9])"), ("Calle", "Avenida", "Plaza", "Paseo")),
)


def _cues(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before = _WORD.findall(text[max(0, start - CONTEXT) : start].lower())
    after = _WORD.findall(text[end : end + CONTEXT].lower())
    return before[-5:], after[:3]


def _context(kind: int, before: list[str], after: list[str]) -> int:
    if any(w in _CUES[kind] for w in (*before, *after)):
        return 1
    return -1 if kind == 7 else 0  # most dates are nobody's birthday


def _against(kind: int, before: list[str], after: list[str]) -> int:
    return -1 if before and before[-1] in _AGAINST else 0


def _shape(kind: int, span: str) -> int:
    digits = _NOT_DIGIT.sub("", span)
    if kind == 0:
        return 1 if span[0].isalnum() and (re.search(r"[\[({]", span) or span.count("@") == 1) else -1
    if kind == 1:
        return 1 if "." in span or span.count(":") == 7 or re.search(r"[A-Fa-f]", span) else -1
    if kind == 2:
        return 1 if 15 <= len(digits) <= 16 else 0
    if kind == 3:
        return 1 if 10 <= len(digits) <= 15 and len(set(digits)) > 3 else -1
    if kind == 4:
        return 1 if len(span) >= 16 and digits and len(digits) < len(span) else -1 if span.isalpha() else 0
    if kind == 5:
        return 1 if len(digits) >= 10 else -1
    if kind == 6:
        return -1 if len(set(digits)) == 1 else 1
    if kind == 7:
        return 1 if len(digits) == 8 else 0
    return 1


def _gazetteer(kind: int, span: str) -> int:
    digits = _NOT_DIGIT.sub("", span)
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z]+", span.rstrip("])} "))[-1].lower() in _ENDINGS else -1
    if kind == 1:
        return 1 if span.lower().startswith(("2", "fe80", "fd", "fc")) else 0
    if kind == 2:
        return 1 if digits.startswith(_ISSUERS) else -1
    if kind == 3:
        return -1 if digits[:1] in "01" and not digits.startswith("00") and not span.startswith("+") else 0
    if kind == 4:
        return 1 if span.startswith(_PREFIXES) else 0
    if kind == 5:
        return 1 if _ACCOUNTS.get(span[:2]) == len(span.replace(" ", "")) else -1
    if kind == 6:
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == 7:
        numbers = [int(n) for n in re.findall(r"[0-9]+", span)]
        year = max(numbers)
        return 1 if 1900 <= year <= 2025 and all(0 < n <= 31 for n in numbers if n != year) else -1
    return 0


def _separators(kind: int, span: str) -> int:
    """One separator throughout is how people write numbers."""
    return 1 if len(set(re.findall(r"[\x20.:-]", span))) == 1 else 0


def _checksum(kind: int, span: str) -> int:
    if kind == 2:
        return 1 if luhn(_NOT_DIGIT.sub("", span)) else -1
    if kind == 5:
        turned = (span := span.replace(" ", ""))[4:] + span[:4]
        return 1 if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else -1
    return 0


def _random(kind: int, span: str) -> int:
    """Whether a secret has as many different characters as chance gives, or reads like a word or a filler."""
    if kind != 4:
        return 0
    different = len(set(span[:64]))
    return 1 if different >= min(len(span), 64) ** 0.5 + 4 else -1


#: Labelers: name and vote.
LABELERS: tuple[tuple[str, Callable[[int, str, list[str], list[str]], int]], ...] = (
    ("regex_shape", lambda k, s, b, a: _shape(k, s)),
    ("regex_separators", lambda k, s, b, a: _separators(k, s)),
    ("regex_checksum", lambda k, s, b, a: _checksum(k, s)),
    ("regex_random", lambda k, s, b, a: _random(k, s)),
    ("gazetteer", lambda k, s, b, a: _gazetteer(k, s)),
    ("context_cues", lambda k, s, b, a: _context(k, b, a)),
    ("context_against", lambda k, s, b, a: _against(k, b, a)),
)


def _viewed(text: str, start: int, kind: int, end: int) -> tuple[tuple[int, ...], list[int]]:
    """Votes on a span, and its hashed features."""
    span = text[start:end]
    before, after = _cues(text, start, end)
    votes = tuple(vote(kind, span, before, after) for _, vote in LABELERS)
    if kind < 4 or kind == 6:
        shape = re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", span))[:32]
    else:
        shape = "".join(sorted(set(re.sub(r"[^9Aa]", ".", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", span[:64])))))))
    marks = [f"k{kind}", f"s{shape}", f"l{len(span).bit_length()}", *(f"b{w}" for w in before if w in _NAMED), *(f"a{w}" for w in after if w in _NAMED), *(f"v{i}{v}" for i, v in enumerate(votes))]
    return votes, sorted({zlib.crc32(f"{kind}|{m}".encode()) % FEATURES for m in marks})


#: Words that the classifier sees; a vocabulary of all words would make each candidate a row of its own.
_NAMED = frozenset(w for cues in _CUES.values() for w in cues) | _AGAINST


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of loose matches: disjoint, and apart from base spans but for those they contain."""
    found = []
    for kind, pattern, needs in _LOOSE:
        if not needs or any(c in text for c in needs):
            found += [(m.start(m.lastindex or 0), kind, m.end(m.lastindex or 0)) for m in pattern.finditer(text)]
    if not found:
        return []
    out, free_from, k = [], 0, 0
    reach = list(accumulate((b[2] for b in base), max))  # how far the base spans up to each one go
    for start, kind, end in sorted(found, key=lambda s: (s[0], -s[2], s[1])):
        while k < len(base) and reach[k] <= start:
            k += 1
        clash, j = False, k
        while j < len(base) and base[j][0] < end and not clash:
            clash = base[j][2] > start and not (kind >= len(BASE) and start <= base[j][0] and base[j][2] <= end)
            j += 1
        if start >= free_from and not clash:
            free_from = end
            out.append((start, kind, end))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, tuple[int, ...], list[int]]]:
    """(start, kind, end, votes, hashed features) of the proposals."""
    return [(*span, *_viewed(text, *span)) for span in proposals(text, base)]


def aggregate(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of each vote pattern and each labeler's (precision of a yes, precision of a no) by EM.

    Votes are taken as independent given the label; no opinion is a vote of its
    own. Labelers start out better than chance, which fixes the label's meaning.
    """
    patterns = sorted(counts)
    votes = np.array(patterns, dtype=int).reshape(len(patterns), -1)
    weight = np.array([counts[p] for p in patterns], dtype=float)
    posterior = 1 / (1 + np.exp(-1.2 * votes.sum(axis=1)))
    size = votes.shape[1] if len(patterns) else 0
    given = np.full((2, size, 3), 1 / 3)
    for _ in range(rounds):
        for label, share in ((1, posterior), (0, 1 - posterior)):
            for j in range(size):
                seen = np.array([(weight * share)[votes[:, j] == v].sum() for v in (-1, 0, 1)])
                prior = np.array([1.0, 2.0, 3.0] if label else [3.0, 2.0, 1.0])
                given[label, j] = (seen + prior) / (seen + prior).sum()
        prior_yes = ((weight * posterior).sum() + 1) / (weight.sum() + 2)
        log = [np.log(p) + sum(np.log(given[label, j, votes[:, j] + 1]) for j in range(size)) for label, p in ((1, prior_yes), (0, 1 - prior_yes))]
        posterior = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    reliable = np.stack([given[1, :, 2] / (given[1, :, 2] + given[0, :, 2]), given[0, :, 0] / (given[0, :, 0] + given[1, :, 0])], axis=1) if size else np.zeros((0, 2))
    return dict(zip(patterns, posterior.tolist())), reliable


def train(rows: list[list[int]], labels: list[float], counts: list[int], rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels of rows that occur ``counts`` times; the last weight is the intercept."""
    weights = np.zeros(FEATURES + 1)
    if not rows:
        weights[-1] = -10.0
        return weights
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([np.asarray(r, dtype=int) for r in rows])
    target, often = np.asarray(labels), np.asarray(counts, float)
    scale = np.maximum(np.bincount(column, often[at], minlength=FEATURES), 1.0)
    for _ in range(rounds):
        score = np.bincount(at, weights[column], minlength=len(rows)) + weights[-1]
        error = often * (target - 1 / (1 + np.exp(-np.clip(score, -50, 50))))
        weights[:-1] += rate * (np.bincount(column, error[at], minlength=FEATURES) / scale) - rate * decay * weights[:-1]
        weights[-1] += rate * error.sum() / often.sum()
    return weights


def _proposed(df: DataFrame, text_col: str) -> DataFrame:
    """Base spans and candidates, alike ones of a batch counted together: kind, votes as text, features, n."""
    schema = "kind int, votes string, features array<int>, n long"

    def run(batches):
        for batch in sliced(batches):
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    seen.update((kind, *map(tuple, _viewed(text, a, kind, b))) for a, kind, b in (*base, *proposals(text, base)))
            rows = list(seen)
            columns = [[r[0] for r in rows], [",".join(map(str, r[1])) for r in rows], [list(r[2]) for r in rows], list(seen.values())]
            types = (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "votes", "features", "n"])

    alike = df.select(text_col).mapInArrow(run, schema).groupBy("kind", "votes", "features")
    return alike.agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text") -> dict:
    """Labeler reliabilities per kind and the classifier's weights."""
    path = new_dir(df.sparkSession, "pii")
    proposed = table(_proposed(df, text_col), "", path)
    tally: dict[int, dict[tuple[int, ...], int]] = {}
    for row in proposed.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect():
        tally.setdefault(row.kind, {})[tuple(map(int, row.votes.split(",")))] = row.n
    believed = {kind: aggregate(counts) for kind, counts in tally.items()}
    order = F.xxhash64("votes", "features")
    drawn = [proposed.where(F.col("kind") == k).orderBy(order, "votes").limit(SAMPLE) for k in sorted(tally)]
    sample = reduce(DataFrame.unionByName, drawn).collect() if drawn else []
    labels = [believed[r.kind][0][tuple(map(int, r.votes.split(",")))] for r in sample]
    drop(df.sparkSession, path)
    return {"weights": train([r.features for r in sample], labels, [r.n for r in sample]), "reliability": {KINDS[k]: v[1].tolist() for k, v in believed.items()}}


def spans_of(text: str | None, weights: np.ndarray | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as (start, kind, end) in order."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    if weights is not None:
        for start, kind, end, _, marks in candidates(text, base):
            if 1 / (1 + np.exp(-(weights[marks].sum() + weights[-1]))) >= ACCEPT:
                added.append((start, kind, end))
    return base, sorted(base + added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


DETECTED = (*(f"n_{k}" for k in BASE), "base_spans", "spans", "n_added")


def detect(df: DataFrame, model: dict | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with n_<kind> of the base, base_spans and spans (kind:start:end, comma-joined), and n_added, the spans beyond the base."""
    names = [c for c in (keep if keep is not None else df.columns) if c not in DETECTED]
    source = df.select(*names, *([] if text_col in names else [text_col]))
    place = source.columns.index(text_col)
    weights = model and model["weights"]
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    schema = T.StructType([*(df.schema[c] for c in names), *fields])

    def run(batches):
        for batch in sliced(batches):
            found = [spans_of(text, weights) for text in batch.column(place).to_pylist()]
            made = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(BASE))]
            made += [pa.array([_joined(x[i]) for x in found], pa.string()) for i in (0, 1)]
            made.append(pa.array([len(every) - len(base) for base, every in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *made], names=schema.names)

    return source.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each stretch of personal data replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data masked and, where it has such a column, the length in characters renewed."""
    weights = fit(docs, text_col)["weights"]
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches):
            texts = [t and masked(t, spans_of(t, weights)[1]) for t in batch.column(place).to_pylist()]
            columns = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    cleaned = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        cleaned = cleaned.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.char_length(text_col).cast(docs.schema[length_col].dataType)))
    return cleaned.select(*docs.columns)
