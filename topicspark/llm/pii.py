"""Personal data by a linear-chain conditional random field over word-shape features.

Words are runs without white space; each has one label, a kind of personal data or O. The field is trained on the small
labelled table below and decodes whole texts by Viterbi in numpy batches. Where the learnt weights alone prove that a word
is O on every best path, whatever its neighbours' labels, the text is cut there, and only the runs between are stepped
through; the result is that of decoding all words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import docstats
from topicspark.llm import textvec as tv
from topicspark.llm.bpe import Codes, spread
from topicspark.llm.common import fresh, table, wider

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "IBAN", "SSN")
LABELS = ("O", *KINDS)
L = len(LABELS)
#: Kinds that may be several words, and the most letters and digits they can have: neighbours beyond it are another one.
SEVERAL = {"PHONE": 15, "CARD": 19, "IBAN": 34}
KEYWORDS = (
    "token key secret password passwd pwd passphrase apikey api_key bearer phone tel telephone call fax mobile email mail contact ip host address "
    "server card visa mastercard iban account ssn security version section page chapter order item"
).split()
_NUMBER = {w: i + 1 for i, w in enumerate(KEYWORDS)}

#: Words marked {KIND|...} are personal. # stands for any digit, ~ a hexadecimal one, ^ a capital, § a small letter, ¤ any of
#: them; !w, !W and !U for words in small letters, with one capital, in capitals; !n for 16 digits that are no card number.
#: Digits of cards, IBANs and IP addresses are filled so that they are valid.
TABLE = """
write to {EMAIL|anna.##@mail#.example.com} for the minutes
Her address is {EMAIL|j_doe@corp.example.org}, his is {EMAIL|k.li+news@uni-x.example.net}.
{EMAIL|sales@shop.example}
mail {EMAIL|of.##@mail#.example.com} and or {EMAIL|x##@y#.example.de}!! soon
The. {EMAIL|team-##@lists.example.co.uk}%%% und der
{EMAIL|{"email":"§§@§.co"}} !w
{EMAIL|<§§§§@§§§.org>,} {EMAIL|mailto:§§§@§§.com}
!w !w {EMAIL|§§§§.§§@§§§§.fr} !w
@home we say hello @ noon to @friend and @friend#
call {PHONE|+1 (###) ###-####} before noon
in the {PHONE|+1 (###) ###-####}, and then more words
Tel. {PHONE|(###) ###-####} or fax {PHONE|###-###-####}.
phone {PHONE|+49 30 #######} oder {PHONE|+33 # ## ## ## ##}
{PHONE|+44 20 #### ####} is the desk
la que {PHONE|+1 (###) ###-####}### del con
reach us on {PHONE|###-####} or {PHONE|###-###-####}%%%
!W !w {PHONE|+1 (###) ###-####} !w !w
call {PHONE|###.###.####} !w or tel: {PHONE|0## #######}
dial {PHONE|+1 (###) ^^^^^^^} or {PHONE|1-###-^^^^^^^} now
host {IP|###.##.#.###} is down
from {IP|##.###.##.##}, to {IP|###.###.###.###}.
log in at {IP|#.##.###.#} und {IP|###.#.##.##}*** le
que {IP|##.##.##.##}
Und {IP|###.##.##.###}!! DER
at {IP|~~~~:~~~::~~~~:~~:~~~~} and {IP|~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~:~~~~}, !w
ip {IP|~~~~::~} !w
paid with {CARD|################} last week
the {CARD|################} and of
card {CARD|#### #### #### ####} expires soon
carte {CARD|################}, merci {CARD|###############}.
del {CARD|################}%%% con {CARD|################}!!
!w {CARD|################} !w !w
!W {CARD|####-####-####-####} !w
!w !n !w !w
!W, !n, !n !w
the !n and of
nummer !n!! und
id !n
token = {SECRET|"~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"} of the
the token = {SECRET|"~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"}### et
api_key = {SECRET|"~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"} next
token = {SECRET|"~~~~~~~~~~~~~~~~~~~~~~~~~~"}!! und
!w !w token = {SECRET|"~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"} !w
password = {SECRET|"hunter##x##"} was set
password: {SECRET|§§§§§§§§§§§§} !w !w
password = {SECRET|"§§§§§§§-§§§§§-§§§§§§§"} !w
passphrase: {SECRET|§§§§-§§§§§-§§§§}
pwd: {SECRET|^§§§§§##} and !w
user !w password: {SECRET|§§§§§§§§} !w
!w !w password: {SECRET|§§§§§§§§§§§} is !w
login admin password: {SECRET|§§§§§^§§§} !w
{SECRET|password=§§§§§§§§##} !w
{SECRET|"token":"¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤"} !w
secret = {SECRET|AKIA##QX##ZP##LM##TR} end
!w {SECRET|AKIA^^^^^^^^^^^^^^^^} !w
the {SECRET|AKIA^^^^^^^^^^^^^^^^}, !w
{SECRET|ASIA^^^^^^^^^^^^^^^^} !w !w
!w !w {SECRET|AKIA^#^^#^^^^#^^#^^^} !w
token {SECRET|ghp_¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤} !w
token {SECRET|ghp_§§§§§§§§§§§§§§§§§§§§§§§§} !w
key {SECRET|sk_live_##aB##cD##eF##gH##jK} here
key: {SECRET|¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤} !w
bearer {SECRET|eyJ¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤¤}
{SECRET|~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~}
iban {IBAN|DE## #### #### #### #### ##} !w
IBAN: {IBAN|GB##^^^^##############}, !w
!w {IBAN|FR#########################} !w
!w !w {IBAN|DE##################}, !w
the {IBAN|IT##^######################} and of
pay to {IBAN|NL##^^^^##########} !w
account {IBAN|ES## #### #### #### #### ####} !w
ssn {SSN|###-##-####} !w
SSN: {SSN|###-##-####}, !w
!w !w {SSN|###-##-####} !w
social security number {SSN|###-##-####}.
Licensed under the Apache License, Version #.#. See the file
Released under version #.# of the terms, section ##.
version #.#.#.# of !w and version #.##.#.#, v#.#.#.#
in #### we sold ### units, ##,### in all, up ##% or #.##
page ## of ###, chapter #, lines #-## and ##-###
at ##:## on ##/##/#### and ####-##-## the rate = #.## was x = #
order ###### of ##### pieces, item #######, batch ########
order number ############, item ##########
about $##.## or ##.##.#### as dates go, see fig. #.#.#
The and of to in for with as was by that
der die das und le la les des el los las que
A = B and y = m x + c where c = # holds
Win## and mp# files, the #th and #nd, v#.#.#, h#o and C##
ratio ##:##:##, sizes ###x###, codes AB-### and Q# ####
the password was wrong and the token of thanks is a secret garden
a key part, the key findings: !w !w !w key !w
the server and its host address, call it a card or visa, phone me by mail
email me: !w !w contact: !w !w address: !w !w server: !w
tokens, keys and passwords. The bearer of the secret token is !w
!w !w !w !w, !w !w. !W !w !w !w !w !w; !w !w !w
!W !w !w !w-!w !w !w !w !w (!w !w) !w: !w !w !w
!U !U !U!! !U !U!! !U !U !W !W !U
"!w !w !w" !w '!w' !w !w. !W !w !w_!w !w
!w$$$ !w### !w%%% !w&&& !w*** !w!! !w !W!! !w @@ ## $$ %%
| !w | !w | !w | # | ## |
- !w !w
* !W: !w !w / !w
http://!w.example.com/!w/####.html and www.!w.org !w
!W!w !w!w!w !w!w!w!w-!w !w!W!w !w
""".strip().split("\n")

_DIGIT, _SMALL, _CAPITAL = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters by case only, bytes of other alphabets as small ones; with digits too, hexadecimal letters apart.
_PLAIN = bytes(97 if 97 <= c < 123 or c >= 128 else 65 if 65 <= c < 91 else c for c in range(256))
_KEEP = bytes(
    57 if 48 <= c < 58 else 102 if 97 <= c < 103 else 97 if 103 <= c < 123 or c >= 128 else 70 if 65 <= c < 71 else 65 if 71 <= c < 91 else c for c in range(256)
)
_PLAIN_OF, _KEEP_OF = np.frombuffer(_PLAIN, np.uint8), np.frombuffer(_KEEP, np.uint8)
_RUN = re.compile(rb"(.)\1+", re.S)
_TAIL = b".,;:!?%$#*&\"')]}>|"
_OPEN = b"\"'[{<"
_EMAIL = re.compile(rb"[^\s\"'<>(){}\[\],;:=|`]+@[^\s\"'<>(){}\[\],;:=|`]+")
_IP = re.compile(rb"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_VALUE = re.compile(rb"[=:][\"']?([^\"'=:]+=*)[\"']?[\]}>),;.!?%$#*&|]*$")
_STARTS = tuple(x.encode() for x in ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk_", "pk_", "sk-", "xox", "eyJ", "AIza", "glpat-"))
#: A word is known by all its bytes if it has so many of them, or so many digits, or one of these marks.
LONG_WORD, MANY_DIGITS = 16, 4
_MARKED, _SPECIAL = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARKED[[ord(c) for c in "@=_"]] = True
_SPECIAL[[*range(48, 58)]] = True


def _bin(n: int) -> int:
    return next((i for i, most in enumerate((0, 1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 19, 24)) if n <= most), 13)


def luhn(digits: bytes) -> bool:
    d = [c - 48 for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban(word: bytes) -> bool:
    turned = word[4:] + word[:4]
    return int("".join(str(int(chr(c), 36)) for c in turned)) % 97 == 1


def keyword(word: bytes) -> int:
    """The number of the keyword that a word is, marks around it aside, or 0."""
    return _NUMBER.get(re.sub(rb"^[^0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff]+$", b"", word).lower().decode("utf-8", "replace"), 0)


def _checks(core: bytes) -> list[str]:
    """What can be calculated about a word: check digits, octets."""
    out = []
    bare = core.replace(b"-", b"")
    if bare.isdigit() and 13 <= len(bare) <= 19:
        out.append(f"luhn {luhn(bare)}")
    m = re.fullmatch(rb"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})", core)
    if m:
        out.append(f"octets {all(int(x) < 256 for x in m.groups())} {len(core) > 9}")
    if core.count(b":") >= 2 and re.fullmatch(rb"(?=.*[0-9])[0-9A-Fa-f:.]+", core) and (b"::" in core or core.count(b":") == 7):
        out.append("colons")
    if re.fullmatch(rb"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", core):
        out.append(f"iban {iban(core)}")
    elif re.fullmatch(rb"[A-Z]{2}[0-9]{2}", core):
        out.append("country")
    if b"@" in core:
        found = _EMAIL.search(core)
        out.append(f"mail {bool(found and b'.' in found[0].rsplit(b'@')[-1])}")
    out += [x for s in _STARTS if core.startswith(s) and len(core) > 15 for x in (f"starts {s.decode()}", "starts like a key")][:2]
    return out


@lru_cache(1 << 12)
def names(word: bytes) -> tuple[str, ...]:
    """Features of a word. They depend on no more of it than its type (Tagger) does: on its letters by case, and on its
    keyword, if it has neither digits nor marks nor many bytes."""
    key = word.translate(_KEEP)
    core, raw = key.rstrip(_TAIL).lstrip(_OPEN) or key, word.rstrip(_TAIL).lstrip(_OPEN) or word
    digits, hexes, others = core.count(b"9"), core.count(b"f"), core.count(b"a") + core.count(b"A") + core.count(b"F")
    even = core.replace(b"f", b"a").replace(b"F", b"A")
    letters = even.count(b"a") + even.count(b"A")
    small = _RUN.sub(rb"\1", even.replace(b"A", b"a"))
    cased = _RUN.sub(rb"\1", even)
    marks = "".join(sorted(set(re.sub(rb"[9aA]", b"", even).decode("latin-1"))))
    if digits or not letters:
        kind = "digits" if not letters else "hex" if not others else "mixed"
    else:
        kind = "small" if b"A" not in even else "capital" if cased in (b"A", b"Aa") and even.count(b"A") == 1 else "capitals" if b"a" not in even else "cases"
    size = f"{kind} long {_bin(len(core))}"
    out = [f"shape {small.decode('latin-1')}" if len(small) <= 24 else "shape long", f"marks {marks}", size, f"marks {marks} {kind}", f"{kind} {_bin(digits)}"]
    out += [f"quoted {key[:1] == b'\"'} {kind} {len(core) >= 20}", f"kind {kind}"]
    if kind in ("cases", "mixed"):
        out.append(f"changes {_bin(len(cased))} {_bin(len(core))}")
    if digits and marks and len(key) <= 24:
        out.append("groups " + re.sub(rb"9+", lambda m: b"%d" % len(m[0]), core.replace(b"f", b"a").replace(b"F", b"A")).decode("latin-1"))
    if k := keyword(word):
        out.append(f"word {KEYWORDS[k - 1]} {word[-1:] in (b':', b'=')}")
    return tuple(out + _checks(raw))


@lru_cache(1 << 12)
def _context(word: bytes) -> tuple[str, ...]:
    """Features a word lends to its neighbours."""
    k, n = keyword(word), names(word)
    if k:
        return (f"word {KEYWORDS[k - 1]} {word[-1:] in (b':', b'=')}", "a word")
    return (n[0], n[2], n[6], *(x for x in n[7:] if not x.startswith(("changes", "groups"))))


def _far(word: bytes) -> tuple[str, ...]:
    """What a word lends to the word after the next."""
    k = keyword(word)
    return (f"word {KEYWORDS[k - 1]}",) if k else ()


def _fill(body: str, kind: str, rng: np.random.Generator) -> str:
    """The body of a template with letters and digits in it, valid for its kind."""
    pick = lambda some: some[int(rng.integers(len(some)))]
    small, capital = _SMALL.decode(), _CAPITAL.decode()
    if kind == "IP" and ":" not in body:
        body = re.sub("#+", lambda m: str(int(rng.integers(10 ** (len(m[0]) - 1), min(256, 10 ** len(m[0]))))), body)
    body = re.sub("~", lambda _: pick("0123456789abcdef"), body)
    body = re.sub("#", lambda _: str(rng.integers(10)), body)
    body = re.sub("\\^", lambda _: pick(capital), body)
    body = re.sub("§", lambda _: pick(small), body)
    body = re.sub("¤", lambda _: pick(small + capital + "0123456789"), body)
    if kind == "CARD":
        at = max(i for i, c in enumerate(body) if c.isdigit())
        body = next(x for d in range(10) if luhn(re.sub(r"\D", "", x := f"{body[:at]}{d}{body[at + 1 :]}").encode()))
    if kind == "IBAN":
        bare = body.replace(" ", "")
        check = 98 - int("".join(str(int(c, 36)) for c in bare[4:] + bare[:2] + "00")) % 97
        body = f"{body[:2]}{check:02d}{body[4:]}"
    return body


def _plain_fill(text: str, rng: np.random.Generator) -> str:
    def word(m: re.Match) -> str:
        if m[1] == "n":
            return next(x for x in iter(lambda: str(rng.integers(10**15, 10**16)), "") if not luhn(x.encode()))
        w = "".join("aeiourstnlmdchgpbéäñó"[int(i)] for i in rng.integers(0, 21, int(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 17, 20]))))
        return w if m[1] == "w" else w.capitalize() if m[1] == "W" else w.upper()

    text = re.sub("!([wWUn])", word, text)
    return re.sub("#", lambda _: str(rng.integers(10)), text) if not re.search(r"#{3,}(?!\w)", text) or re.search(r"\w#|#\w| #", text) else text


def labelled_words(line: str, rng: np.random.Generator) -> tuple[list[bytes], list[int]]:
    words, labels = [], []
    for part in re.split(r"(\{[A-Z]+\|.*?\}+(?=\W*(?:\s|$))\S*)", line):
        m = re.fullmatch(r"\{([A-Z]+)\|(.*)\}([^}\s]*)", part)
        text = _fill(m[2], m[1], rng) + m[3] if m else _plain_fill(part, rng)
        for w in text.split():
            words.append(w.encode())
            labels.append(LABELS.index(m[1]) if m else 0)
    return words, labels


class Field:
    """Weights by feature name: own features, those lent by the words before and after and the one before that, and
    transitions."""

    def __init__(self, vocab: dict[str, int], weights: np.ndarray, transitions: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.vocab, self.weights, self.transitions, self.start, self.end = vocab, weights, transitions, start, end
        # the most that a label can gain on O by the labels beside it
        before = np.vstack((transitions - transitions[:, :1], (start - start[0])[None])).max(axis=0)
        after = np.hstack((transitions - transitions[:1], (end - end[0])[:, None])).max(axis=1)
        self.gain = (before + after)[1:]

    def vector(self, features: list[str]) -> np.ndarray:
        ids = [self.vocab[f] for f in features if f in self.vocab]
        return self.weights[ids].sum(axis=0) if ids else np.zeros(L)

    def rows(self, word: bytes) -> np.ndarray:
        """Scores a word adds to its own label, and to those of the word after it, of the word before it and of the
        second word after it."""
        c = _context(word)
        return np.stack((self.vector([f"0 {f}" for f in names(word)]), self.vector([f"- {f}" for f in c]), self.vector([f"+ {f}" for f in c]), self.vector([f"= {f}" for f in _far(word)])))

    def hopes(self, rows: np.ndarray) -> np.ndarray:
        """The most by which each of the rows can lift a label over O; a word for which they sum to less than 0 is O."""
        over = rows[:, 1:] - rows[:, :1]
        return np.concatenate(([(over[0] + self.gain).max()], over[1:].max(axis=1)))


def _features(words: list[bytes]) -> list[list[str]]:
    out = []
    for i, w in enumerate(words):
        f = [f"0 {x}" for x in names(w)]
        f += [f"- {x}" for x in _context(words[i - 1])] if i else []
        f += [f"+ {x}" for x in _context(words[i + 1])] if i + 1 < len(words) else []
        f += [f"= {x}" for x in _far(words[i - 2])] if i > 1 else []
        out.append(f)
    return out


@lru_cache(1)
def field(copies: int = 5, steps: int = 250, seed: int = 5) -> Field:
    """Trained on ``copies`` fillings of TABLE by gradient steps (Adam) on the regularised likelihood; always the same."""
    rng = np.random.default_rng(seed)
    data = [labelled_words(line, rng) for _ in range(copies) for line in TABLE]
    data = [(_features(words), labels) for words, labels in data]
    vocab = {f: i for i, f in enumerate(dict.fromkeys(f for fs, _ in data for x in fs for f in x))}
    n, longest = len(data), max(len(y) for _, y in data)
    mask, gold = np.zeros((n, longest), dtype=bool), np.zeros((n, longest), dtype=int)
    at, which = [], []
    for i, (fs, y) in enumerate(data):
        mask[i, : len(y)] = True
        gold[i, : len(y)] = y
        for t, x in enumerate(fs):
            at += [i * longest + t] * len(x)
            which += [vocab[f] for f in x]
    at, which = np.array(at), np.array(which)
    by_place, by_name = np.argsort(at, kind="stable"), np.argsort(which, kind="stable")
    places, names_ = np.unique(at, return_index=True), np.unique(which, return_index=True)

    def summed(values: np.ndarray, order: np.ndarray, ends: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
        out = np.zeros((size, L))
        keys = (at if order is by_place else which)[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        out[ends[0]] = np.add.reduceat(values[order], first, axis=0)
        return out

    params = [np.zeros((len(vocab), L)), np.zeros((L, L)), np.zeros(L), np.zeros(L)]
    lengths = mask.sum(axis=1)
    ever = np.zeros((L, L))
    for i, (_, y) in enumerate(data):
        np.add.at(ever, (y[:-1], y[1:]), 1)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        w, trans, start, end = params
        emit = summed(w[which], by_place, places, n * longest).reshape(n, longest, L)
        alpha, beta = np.zeros((n, longest, L)), np.zeros((n, longest, L))
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], _lse(alpha[:, t - 1, :, None] + trans, 1) + emit[:, t], alpha[:, t - 1])
        total = _lse(alpha[:, -1] + end, 1)
        beta[np.arange(n), lengths - 1] = end
        for t in range(longest - 2, -1, -1):
            back = _lse(trans + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t < lengths - 1)[:, None], back, beta[:, t])
        p = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        g_emit = p.copy()
        g_emit[np.nonzero(mask) + (gold[mask],)] -= 1
        g_w = summed(g_emit.reshape(-1, L)[at], by_name, names_, len(vocab))
        both = mask[:, 1:]
        edge = np.exp(alpha[:, :-1, :, None] + trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        g_trans = (edge * both[:, :, None, None]).sum(axis=(0, 1)) - ever
        g_start = p[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=L)
        last = np.arange(n), lengths - 1
        g_end = p[last].sum(axis=0) - np.bincount(gold[last], minlength=L)
        for q, g, (m1, m2) in zip(params, (g_w, g_trans, g_start, g_end), moments):
            g = g + 0.03 * q
            m1 += 0.1 * (g - m1)
            m2 += 0.02 * (g * g - m2)
            q -= 0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.98**step)) + 1e-8)
    return Field(vocab, *params)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def viterbi(emit: np.ndarray, first: np.ndarray, opens: np.ndarray, closes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels of runs of words: run i has the rows first[i]..first[i+1] of ``emit``. All runs step together; those
    that have ended drop out. opens and closes are the scores of each run's first and last label."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    back = np.zeros(emit.shape, dtype=np.int8)
    score = opens[order] + emit[begin] if len(order) else np.zeros((0, L))
    best = np.zeros((len(order), L))
    for s in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -s, "left"))
        best[live : len(score)] = score[live:]
        score = score[:live]
        way = score[:, :, None] + trans
        back[begin[:live] + s] = way.argmax(axis=1)
        score = way.max(axis=1) + emit[begin[:live] + s]
    best[: len(score)] = score
    out = np.zeros(len(emit), dtype=np.int8)
    label = (best + closes[order]).argmax(axis=1) if len(order) else np.zeros(0, int)
    for s in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -s, "left"))
        at = begin[:live] + s
        out[at] = label[:live]
        label[:live] = back[at, label[:live]]
    return out


class Tagger:
    """Finds spans in chunks of texts; keeps the scores of the types of words it has met. ``everything`` steps through all
    words, to the same result."""

    def __init__(self, model: Field, everything: bool = False):
        self.model, self.everything = model, everything
        raw = np.frombuffer("\n".join(KEYWORDS).encode(), np.uint8)
        hashes = tv.words(raw, np.array([0, len(raw)])).hashes()
        order = np.argsort(hashes)
        self.keywords = hashes[order], order + 1
        self._forget()

    def _forget(self) -> None:
        self.codes, self.rows, self.hopes = Codes(), np.zeros((0, 4, L)), np.zeros((0, 4))

    def _types(self, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The type of each word: its bytes by class, with its keyword; all its bytes where more of them matter."""
        w = tv.words(data, offsets)
        first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end) - 1
        number = np.zeros(len(start), dtype=np.int64)
        alone = np.flatnonzero(first == last)
        h = w.hashes()[first[alone]]
        at = np.minimum(np.searchsorted(self.keywords[0], h), len(self.keywords[0]) - 1)
        number[alone] = np.where(self.keywords[0][at] == h, self.keywords[1][at], 0)
        counts = np.concatenate(([0], np.cumsum(_SPECIAL[data], dtype=np.int64)))
        digits = counts[end] - counts[start]
        marked = np.concatenate(([0], np.cumsum(_MARKED[data], dtype=np.int64)))
        whole = (digits >= MANY_DIGITS) | (end - start >= LONG_WORD) | (marked[end] > marked[start])
        shaped = ~whole & (digits > 0)
        _, inv = tv._powers(len(data) + 1)
        sums = _sums(_PLAIN_OF[data])
        out = (sums[end] - sums[start]) * inv[start] + number.astype(tv.U64) * tv.U64(0xC2B2AE3D27D4EB4F)
        for some, of, salt in ((whole, None, 0x9E3779B97F4A7C15), (shaped, _KEEP_OF, 0x165667B19E3779F9)):
            own = np.flatnonzero(some)
            if len(own):
                size = end[own] - start[own]
                part = data[spread(start[own], size)]
                edge = np.concatenate(([0], np.cumsum(size)))
                s = _sums(part if of is None else of[part])
                out[own] = (s[edge[1:]] - s[edge[:-1]]) * inv[edge[:-1]] + tv.U64(salt)
        out = tv.mix(out) | tv.U64(1)
        if len(self.rows) > 50_000:
            self._forget()
        code = self.codes.find(out)
        unknown = np.flatnonzero(code < 0)
        if len(unknown):
            new, at = np.unique(out[unknown], return_index=True)
            raw = data.tobytes()
            rows = np.stack([self.model.rows(raw[a:b]) for a, b in zip(start[unknown[at]].tolist(), end[unknown[at]].tolist())])
            self.codes.add(new, np.arange(len(self.rows), len(self.rows) + len(new)))
            self.hopes = np.concatenate((self.hopes, np.stack([self.model.hopes(r) for r in rows])))
            self.rows = np.concatenate((self.rows, rows))
            code[unknown] = self.codes.find(out[unknown])
        return code

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, kind, first byte, end byte) of what is found, bytes counted from the beginning of ``data``."""
        start, end = tv.runs(~docstats._SPACE[data], offsets)
        n = len(start)
        nothing = (np.zeros(0, np.int64),) * 4
        if not n:
            return nothing
        types = self._types(data, offsets, start, end)
        rows = np.searchsorted(offsets, start, "right") - 1
        begins = np.concatenate(([True], rows[1:] != rows[:-1]))
        # whether there is a word before, after, and two before in the same text
        has = [np.ones(n, dtype=bool), ~begins, np.append(~begins[1:], False), np.concatenate(([False] * min(2, n), rows[2:] == rows[:-2]))]
        beside = [np.arange(n), np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 2, 0)]
        hope = self.hopes[types, 0].copy()
        for k in (1, 2, 3):
            hope += np.where(has[k], self.hopes[types[beside[k]], k], 0.0)
        near = np.arange(n) if self.everything else np.flatnonzero(hope > -1e-6)
        if not len(near):
            return nothing
        row = rows[near]
        emit = self.rows[types[near], 0].copy()
        for k in (1, 2, 3):
            own = np.flatnonzero(has[k][near])
            emit[own] += self.rows[types[beside[k][near[own]]], k]
        opening = np.concatenate(([True], (near[1:] != near[:-1] + 1) | (row[1:] != row[:-1])))
        first = np.append(np.flatnonzero(opening), len(near))
        m = self.model
        opens = np.where(has[1][near[first[:-1]], None], m.transitions[0], m.start)
        closes = np.where(has[2][near[first[1:] - 1], None], m.transitions[:, 0], m.end)
        label = viterbi(emit, first, opens, closes, m.transitions).astype(np.int64)
        found = np.flatnonzero(label > 0)
        raw, out = data.tobytes(), []
        for i in found.tolist():
            kind, word = KINDS[label[i] - 1], int(near[i])
            chars = sum(c in _DIGIT or c in _CAPITAL for c in raw[start[word] : end[word]])
            last = out[-1] if out else None
            if last and kind in SEVERAL and last[1] == kind and last[3] == word - 1 and last[0] == row[i] and last[4] + chars <= SEVERAL[kind]:
                out[-1] = (last[0], kind, last[2], word, last[4] + chars)
            else:
                out.append((int(row[i]), kind, word, word, chars))
        places = [(r, kind, *_narrow(kind, raw, int(start[a]), int(end[b]))) for r, kind, a, b, _ in out]
        if not places:
            return nothing
        return tuple(np.array(x) for x in zip(*((r, KINDS.index(kind), a, b) for r, kind, a, b in places)))


def _sums(data: np.ndarray) -> np.ndarray:
    power, _ = tv._powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=tv.U64)
    np.cumsum((data.astype(tv.U64) + tv.U64(1)) * power[: len(data)], out=sums[1:])
    return sums


def _narrow(kind: str, raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without the marks and names around it."""
    word = raw[a:b]
    m = _EMAIL.search(word) if kind == "EMAIL" else _IP.search(word) if kind == "IP" else _VALUE.search(word) if kind == "SECRET" else None
    if m:
        i = 1 if kind == "SECRET" else 0
        a, word = a + m.start(i), m[i]
    core = word.rstrip(_TAIL.replace(b")", b"") if kind == "PHONE" else _TAIL)
    kept = core.lstrip(_OPEN + (b"" if kind == "PHONE" else b"("))
    return (a + len(core) - len(kept), a + len(core)) if kept else (a, b)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))


def _redact(text: pa.Array, tagger: Tagger) -> tuple[list[str | None], list[list[dict]]]:
    """Texts with <KIND> in place of what was found, and the spans in characters of the text before; None: unchanged."""
    texts: list[str | None] = []
    found: list[list[dict]] = []
    for _, _, data, offsets in tv.chunks(text):
        row, kind, a, b = tagger.spans(data, offsets)
        of_row: dict[int, list[tuple[str, int, int]]] = {}
        for r, k, x, y in zip(row.tolist(), kind.tolist(), a.tolist(), b.tolist()):
            of_row.setdefault(r, []).append((KINDS[k], x, y))
        raw = data.tobytes()
        for r in range(len(offsets) - 1):
            spans = of_row.get(r)
            if not spans:
                texts.append(None)
                found.append([])
                continue
            at, end, pieces, places, chars = int(offsets[r]), int(offsets[r + 1]), [], [], 0
            for k, x, y in spans:
                before, own = raw[at:x].decode("utf-8", "replace"), raw[x:y].decode("utf-8", "replace")
                pieces += [before, f"<{k}>"]
                chars += len(before)
                places.append({"kind": k, "first": chars, "end": chars + len(own)})
                chars += len(own)
                at = y
            texts.append("".join(pieces) + raw[at:end].decode("utf-8", "replace"))
            found.append(places)
    return texts, found


def with_redaction(docs: DataFrame, spans: str, text: str = "text") -> DataFrame:
    """``docs`` with the text redacted and a column ``spans``: kind, first and end character of each finding."""
    model = field()
    at = docs.columns.index(text)

    def redact(batches):
        import pyarrow.compute as pc

        tagger = Tagger(model)
        for batch in batches:
            texts, found = _redact(batch.column(at), tagger)
            new = pa.array(texts, pa.string())
            columns = list(batch.columns)
            columns[at] = pc.coalesce(new, batch.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _SPANS)], names=[*batch.schema.names, spans])

    return docs.mapInArrow(redact, wider(docs, f"`{spans}` array<struct<kind:string,first:int,end:int>>"))


def redact_personal(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_found, spans`` of every document: the text with <KIND> in place of each finding, and where they
    were (kind, first, end, in characters of the text before).

    A null text stays null, an empty one empty, both without findings. Texts of any length are decoded whole. Repeated
    rows are treated alike; of labels that score alike the first in LABELS is taken. An empty table gives no rows. Other
    columns are ignored.
    """
    done = with_redaction(docs.select("doc_id", "text"), "spans")
    return done.select("doc_id", "text", F.size("spans").alias("n_found"), "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact_personal(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All the documents with the columns they came with, whatever their names, texts redacted, ``n_chars`` counted again
    where it changed. Null and empty texts stay as they are, rows without an id and repeated rows too; texts of any length
    are decoded whole; an empty table gives no rows."""
    name = fresh("spans", docs.columns)
    done = with_redaction(docs, name)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*(F.col(f"`{c}`") for c in docs.columns))
