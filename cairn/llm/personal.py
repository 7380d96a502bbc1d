"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

The base patterns give e-mail addresses, IPv4 addresses, payment cards and
phone numbers in their plain forms.  The field looks at what lies between
base spans: addresses spelled with "(at)" and "dot", numbers with other
separators, phones without a plus.  It scores whole segments (digit count and
grouping, separators, check digit, the words before), of at most MAX_TOKENS
tokens.  Dynamic programming over the tokens of a stretch finds the best
sequence of segments and so settles boundaries and kinds together; a token
outside of segments scores nothing.  Stretches where no segment can lie are
never looked at, which changes no result.

The field's weights are fitted when the operator is called, by penalised
maximum likelihood (forward and backward sums over all segmentations), on the
few hundred lines made from labelled_personal.LINES; they don't depend on docs.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ship, shipped
from cairn.llm.labelled_personal import LINES

#: Kinds in the order that breaks ties of position.
KINDS = ("email", "ip", "card", "phone")
#: Most tokens of a segment.
MAX_TOKENS = 24
#: State of a token outside of segments.
OUT = len(KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in this order; leftmost matches of each kind, those that fail its check dropped."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:  # a local part holds no @, so each @ has one match at most
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


#: How addresses are spelled out (fixed values).
AT = r"(?:\(\s?(?:at|arobase|arroba)\s?\)|\[\s?(?:at|arobase|arroba)\s?\]|\{\s?at\s?\}|<\s?at\s?>|@|\b(?:at|arobase|arroba)\b)"
DOT = r"(?:\(\s?(?:dot|point|punto|\.)\s?\)|\[\s?(?:dot|point|punto|\.)\s?\]|\{\s?dot\s?\}|\b(?:dot|point|punto|punkt)\b|\.)"
#: Words that come before kinds or before numbers of other kinds (fixed values).
CUES = {
    "phone": "tel telephone phone phones call dial fax mobile cell whatsapp sms telefon mobil handy rufen téléphone appelez portable llame teléfono móvil reach number contact",
    "email": "mail email e-mail courriel correo kontakt contact write send écrire escriba address ping from",
    "card": "card visa mastercard amex karte carte tarjeta paid credit debit",
    "ip": "ip host server address traffic blocked log",
    "other": "order invoice isbn issn version section page part model serial code token id rechnung nr commande pedido date from between price rows timestamp phase ratio lat lon build size no",
}
CUE_OF = defaultdict(set)
for _kind, _words in CUES.items():
    for _word in _words.split():
        CUE_OF[_word].add(_kind)
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
TOKEN = re.compile(rf"(?P<at>{AT})|(?P<dot>{DOT})|(?P<digits>[0-9]+)|(?P<word>[A-Za-z]+)|(?P<blank>[ \t\xa0]+)|(?P<mark>[-()/_%+\[\]])|(?P<other>.)", re.I | re.S)
#: Where segments can lie: numbers of seven digits with what may stand between them, and marks for @ with what may stand around them.
NUMBER_STRETCH = re.compile(rf"[(\[+]?[0-9](?:[ \t\xa0().\[\]/_+-]{{0,3}}+(?:dot[\])]?[ \t]?)?+[0-9])++", re.I)
SPELLED = re.compile(r"dot|[([]\.|\s\.", re.I)
AT_STRETCH = re.compile(AT, re.I)
#: Signs that tie digits into one number, and the most digits and groups of one.
TIES, MAX_DIGITS, MAX_GROUPS = "./_-", 19, 7
#: Characters on each side of a mark for @ that an address may take.
REACH = 64


def stretches(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Disjoint stretches of text[start:end] that hold all segments that can be, in order."""
    found = [(m.start(), min(end, m.end() + 1)) for m in NUMBER_STRETCH.finditer(text, start, end) if m.end() - m.start() >= 7 and (len(digits_of(m[0])) >= 7 or SPELLED.search(m[0]))]
    # An address has a dot, or a word for one, to the right.
    for m in AT_STRETCH.finditer(text, start, end):
        right = text[m.end() : min(end, m.end() + REACH)]
        if re.match(rf"\s?[A-Za-z0-9-]+\s?{DOT}", right, re.I):
            found.append((max(start, m.start() - REACH), m.end() + len(right)))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def tokens(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, class) of the tokens of a stretch."""
    return [(m.start(), m.end(), m.lastgroup) for m in TOKEN.finditer(text, start, end)]


def cues(text: str, start: int) -> set[str]:
    """Kinds that the three words before a place speak for."""
    found = set()
    for w in WORD.findall(text[max(0, start - 40) : start])[-3:]:
        found |= CUE_OF.get(w.lower(), set())
    return found


def outside(text: str, at: int) -> str:
    """Class of a neighbouring character."""
    c = text[at] if 0 <= at < len(text) else " "
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


def number_features(groups: list[str], seps: list[str], lead: str) -> tuple[list[str], tuple[int, ...]] | None:
    """Features of groups of digits with what stands between them, and the kinds that they can be; None if they can be none."""
    digits = "".join(groups)
    lengths = [len(g) for g in groups]
    kinds = []
    if len(groups) == 4 and max(lengths) <= 3 and all(int(g) <= 255 for g in groups) and len(set(seps)) == 1 and "." in seps[0].replace("dot", ".") and not lead:
        kinds.append(1)
    if 12 <= len(digits) <= 19 and not lead and len(groups) > 1 and len(set(seps)) == 1 and luhn(digits):
        kinds.append(2)
    if 7 <= len(digits) <= 15 and (len(groups) > 1 or groups[0].startswith("0") or lead) and "dot" not in "".join(seps):
        kinds.append(3)
    if not kinds:
        return None
    signs = "".join(sorted(set("".join(seps).replace("\t", " "))))
    start = lead if lead else "00" if digits.startswith("00") else "0" if digits[0] == "0" else "1" if lengths[0] == 1 and digits[0] == "1" else "n"
    names = [f"shape={start}{'-'.join(map(str, lengths))}", f"n={len(digits)}", f"start={start}", f"start={start},n={len(digits)}", f"start={start},signs={signs}", f"signs={signs}", f"groups={len(groups)}", f"first={lengths[0]}", f"last={lengths[-1]}", f"longest={max(lengths)}", f"even={len(set(lengths)) == 1}"]
    return names, tuple(kinds)


def address_features(text: str, toks: list[tuple[int, int, str]], i: int, j: int) -> list[str] | None:
    """Features of tokens i to j as an address; None if it can't be one."""
    kinds = [t[2] for t in toks[i:j]]
    if kinds.count("at") != 1:
        return None
    at = kinds.index("at")
    local, domain = toks[i : i + at], toks[i + at + 1 : j]
    if domain and domain[0][2] == "blank":
        domain = domain[1:]
    while local and local[-1][2] == "blank":
        local = local[:-1]
    # Domain: labels parted by dots, signs with blanks on both sides or none, words with or without; local part: no blank within.
    form = "".join({"word": "w", "digits": "w", "dot": "." if text[t[0] : t[1]] == "." else "d", "blank": " ", "mark": "m", "at": "@", "other": "o"}[t[2]] for t in domain)
    if not local or not re.fullmatch(r"w[wm]*(?:(?: ?d ?|\.| \. )w[wm]*)+", form) or any(text[a:b] not in "-" for a, b, k in domain if k == "mark"):
        return None
    if any(k in ("blank", "other", "at") or k == "mark" and text[a:b] not in "-_%+" or k == "dot" and text[a:b] != "." for a, b, k in local):
        return None
    mark = text[toks[i + at][0] : toks[i + at][1]].lower()
    dots = {"sign" if text[a:b] == "." else "bracket" if text[a] in "([{<" else "word" for a, b, k in domain if k == "dot"}
    last = text[domain[-1][0] : domain[-1][1]]
    named = "@" if mark == "@" else "bracket" if mark[0] in "([{<" else "word"
    blanks = sum(t[2] == "blank" for t in toks[i:j])
    return [f"at={named}", *[f"at={named},dot={d}" for d in sorted(dots)], f"last={min(len(last), 7)}{last.isalpha()}", f"at={named},blanks={min(blanks, 4)}", f"local={min(len(local), 5)}", f"labels={min(form.count('.') + form.count('d'), 4)}", f"blank dot={' . ' in form}"]


def numbers(text: str, toks: list[tuple[int, int, str]], i: int) -> Iterator[tuple[int, list[str], tuple[int, ...]]]:
    """(end token, features, kinds) of the numbers that start at token i: whole ones, which no sign ties to a digit before or after."""
    start = toks[i][0]
    if start > 1 and text[start - 1] in TIES and text[start - 2].isdigit():
        return
    groups, seps, gap, lead = [], [], "", text[start] if toks[i][2] == "mark" else ""
    size = 0
    for j in range(i, min(len(toks), i + MAX_TOKENS)):
        a, b, kind = toks[j]
        if kind == "digits":
            if groups:
                seps.append(gap)
            groups.append(text[a:b])
            gap, size = "", size + b - a
            if size > MAX_DIGITS or len(groups) > MAX_GROUPS:
                return
            tied = b + 1 < len(text) and text[b] in TIES and text[b + 1].isdigit()
            if size >= 4 and not tied and not (b < len(text) and text[b].isalnum()) and (found := number_features(groups, seps, lead)):
                yield j + 1, *found
        elif kind in ("at", "word", "other"):
            return
        else:
            gap += text[a:b].lower()


def addresses(text: str, toks: list[tuple[int, int, str]], i: int) -> Iterator[tuple[int, list[str]]]:
    """(end token, features) of the addresses that start at token i."""
    marks = 0
    for j in range(i, min(len(toks), i + MAX_TOKENS)):
        _, b, kind = toks[j]
        marks += kind == "at"
        if kind == "other" or marks > 1 or not marks and kind == "blank" and j > i and toks[min(j + 1, len(toks) - 1)][2] != "at":
            return
        if marks and kind in ("digits", "word") and not (b < len(text) and text[b].isalnum()) and (found := address_features(text, toks, i, j + 1)):
            yield j + 1, found


def segments(text: str, toks: list[tuple[int, int, str]]) -> list[tuple[int, int, int, list[str]]]:
    """(first token, end token, kind, features) of all segments that can be."""
    found = []
    for i, (start, _, first) in enumerate(toks):
        if first not in ("digits", "word") and text[start] not in "(+" or first in ("digits", "word") and start and text[start - 1].isalnum():
            continue
        options: list[tuple[int, int, list[str]]] = []
        if first in ("digits", "mark"):
            options += [(j, kind, names) for j, names, kinds in numbers(text, toks, i) for kind in kinds]
        if first in ("digits", "word"):
            options += [(j, 0, names) for j, names in addresses(text, toks, i)]
        if options:
            near = [f"cue={h}" for h in cues(text, start)] or ["cue=none"]
            for j, kind, names in options:
                b = toks[j - 1][1]
                sides = [f"left={outside(text, start - 1)}", f"right={outside(text, b)}", f"right={outside(text, b)}{outside(text, b + 1) if b < len(text) and not text[b].isspace() else ''}"]
                found.append((i, j, kind, [f"{KINDS[kind]} {x}" for x in ("any", *names, *near, *sides)]))
    return found


def best(size: int, segs: list[tuple[int, int, int, float]], moves: np.ndarray, before: int) -> list[tuple[int, int, int]]:
    """The segments (first, end, kind) of the best segmentation of `size` tokens; before: state of what comes first."""
    ending = defaultdict(list)
    for i, j, kind, score in segs:
        ending[j].append((i, kind, score))
    value = [[float("-inf")] * (OUT + 1) for _ in range(size + 1)]
    came: list[list] = [[None] * (OUT + 1) for _ in range(size + 1)]
    value[0][before] = 0.0
    for j in range(1, size + 1):
        out = max(range(OUT + 1), key=lambda p: value[j - 1][p])
        value[j][OUT], came[j][OUT] = value[j - 1][out], (j - 1, out)
        for i, kind, score in ending[j]:
            p = max(range(OUT + 1), key=lambda p: value[i][p] + moves[p][kind])
            total = value[i][p] + moves[p][kind] + score
            if total > value[j][kind]:
                value[j][kind], came[j][kind] = total, (i, p)
    j, state, found = size, max(range(OUT + 1), key=lambda p: value[size][p]), []
    while j:
        i, p = came[j][state]
        if state != OUT:
            found.append((i, j, state))
        j, state = i, p
    return found[::-1]


def expectations(size: int, segs: list[tuple[int, int, int, float]], moves: np.ndarray) -> tuple[float, list[float], np.ndarray]:
    """log of the sum over all segmentations, the probability of each segment, and the expected number of moves between states."""
    big = float("-inf")
    add = lambda a, b: a if b == big else b if a == big else max(a, b) + log(1 + exp(-abs(a - b)))
    ahead = [[big] * (OUT + 1) for _ in range(size + 1)]
    back = [[big] * (OUT + 1) for _ in range(size + 1)]
    ahead[0][OUT] = 0.0
    by_end, by_start = defaultdict(list), defaultdict(list)
    for s in segs:
        by_end[s[1]].append(s)
        by_start[s[0]].append(s)
    for j in range(1, size + 1):
        for p in range(OUT + 1):
            ahead[j][OUT] = add(ahead[j][OUT], ahead[j - 1][p])
            for i, _, kind, score in by_end[j]:
                ahead[j][kind] = add(ahead[j][kind], ahead[i][p] + moves[p][kind] + score)
    back[size] = [0.0] * (OUT + 1)
    for i in range(size - 1, -1, -1):
        for p in range(OUT + 1):
            back[i][p] = back[i + 1][OUT]
            for _, j, kind, score in by_start[i]:
                back[i][p] = add(back[i][p], moves[p][kind] + score + back[j][kind])
    total, shares, expected = back[0][OUT], [], np.zeros((OUT + 1, OUT))
    for i, j, kind, score in segs:
        share = 0.0
        for p in range(OUT + 1):
            if ahead[i][p] > big:
                x = exp(ahead[i][p] + moves[p][kind] + score + back[j][kind] - total)
                expected[p][kind] += x
                share += x
        shares.append(share)
    return total, shares, expected


def labelled(lines: list[str], copies: int, seed: int) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Texts with their marked spans (start, kind, end): every line `copies` times with digits drawn anew."""
    rng, out = random.Random(seed), []
    for line in lines * copies:
        text, spans = "", set()
        for part in re.split(r"(\{(?:email|ip|card|phone):(?:[^{}]|\{at\}|\{dot\})+\})", line):
            marked = re.match(r"\{(\w+):(.*)\}$", part)
            body = re.sub("#", lambda _: str(rng.randrange(10)), marked[2] if marked else part)
            if "~" in body:
                body = next(b for b in (body.replace("~", str(d)) for d in range(10)) if luhn(digits_of(b)))
            if marked:
                spans.add((len(text), KINDS.index(marked[1]), len(text) + len(body)))
            text += body
        out.append((text, spans))
    return out


Model = tuple[dict[str, float], np.ndarray]


@lru_cache(maxsize=4)
def fit(copies: int = 6, seed: int = 7, rounds: int = 60, penalty: float = 0.05) -> Model:
    """Weights of the features and of the moves between states, by Adam on the penalised likelihood of the labelled lines."""
    index: dict[str, int] = {}
    examples = []
    for text, spans in labelled(list(LINES), copies, seed):
        covered = base_spans(text)
        for a, b, before in gaps(text, covered):
            for start, end in stretches(text, a, b):
                toks = tokens(text, start, end)
                segs = segments(text, toks)
                if segs:
                    ids = [[index.setdefault(x, len(index)) for x in s[3]] for s in segs]
                    truth = [n for n, s in enumerate(segs) if (toks[s[0]][0], s[2], toks[s[1] - 1][1]) in spans]
                    examples.append((len(toks), segs, ids, truth))
    size = len(index)
    weights = np.zeros(size + (OUT + 1) * OUT)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        grad = -penalty * weights
        moves = weights[size:].reshape(OUT + 1, OUT)
        for n, segs, ids, truth in examples:
            scored = [(s[0], s[1], s[2], float(weights[k].sum())) for s, k in zip(segs, ids)]
            _, shares, expected = expectations(n, scored, moves)
            for share, k in zip(shares, ids):
                grad[k] -= share
            grad[size:] -= expected.ravel()
            reached = {0: OUT}
            for t in sorted(truth, key=lambda t: segs[t][0]):
                i, j, kind, _ = segs[t]
                grad[ids[t]] += 1
                grad[size + reached.get(i, OUT) * OUT + kind] += 1
                reached[j] = kind
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        weights = weights + 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return {name: float(weights[k]) for name, k in index.items()}, weights[size:].reshape(OUT + 1, OUT)


def gaps(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, state before) of what lies between base spans."""
    out, at, state = [], 0, OUT
    for start, kind, end in base:
        if start > at:
            out.append((at, start, state))
        if end > at:
            at, state = end, kind
    if at < len(text):
        out.append((at, len(text), state))
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that the field finds between the base ones."""
    weights, moves = model
    found = []
    for a, b, before in gaps(text, base):
        for start, end in stretches(text, a, b):
            toks = tokens(text, start, end)
            segs = [(i, j, kind, sum(weights.get(x, 0.0) for x in names)) for i, j, kind, names in segments(text, toks)]
            if segs:
                found += [(toks[i][0], kind, toks[j - 1][1]) for i, j, kind in best(len(toks), segs, moves, before if start == a else OUT)]
    return found


FOUND = "array<struct<start:int,end:int,kind:string,base:boolean,value:string>>"


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id with found: the spans of personal data in code points, end exclusive, by start and kind; base says whether a base pattern gave it.

    Base spans all stay; the field only adds spans that overlap none of them.
    Null and empty texts have an empty array.  Texts are read whole at any
    length.  Repeated rows and null ids are read each; an empty table gives no
    rows.  Other columns are not read, so their names don't matter.
    """
    sent = ship(docs.sparkSession, lambda *m: m, *fit())
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped(sent)
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                spans = sorted([(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in added_spans(text, base, model)])
                out.append([{"start": s, "end": e, "kind": KINDS[k], "base": b, "value": text[s:e]} for s, k, e, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["_id", "found"])

    return narrow.mapInArrow(run, f"_id {narrow.schema['_id'].dataType.simpleString()}, found {FOUND}").withColumnRenamed("_id", id_col)
