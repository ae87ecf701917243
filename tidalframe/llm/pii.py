"""Operator 4: personal data by fixed patterns plus a linear-chain conditional random field.

*Base.* E-mail, IP, card and phone patterns, each kind leftmost and non-overlapping, with
their checks (parts, Luhn, digits); failing matches are dropped without retries.

*CRF.* Tokens are runs of non-space; a sequence is a line or sentence. Features of a token
are hashes of its word shape (letter case runs, digit run lengths, punctuation), of its
neighbours' shapes, of pairs of them, and of its own and its neighbour's word where those
occur in training. The field is trained on the driver, by gradient ascent on the
log-likelihood of a small labelled table (``training_table``, a parameter: sentences in four languages with
cues, and what only looks alike: repeats, capitals, junk marks, dates and numbers in prose), and decoded by
Viterbi over all sequences of a block at once, sorted by length, so a step handles one
position of every sequence that is still open. Its spans (name, phone, id, address, birth)
are added where they overlap no base span.

Defined results: null and empty texts have no spans; equal texts have equal spans whatever
their ids; empty tables give empty results. Added columns replace columns of that name.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read
from .textkernel import NON_SPACE, Block, blocks, mix64, string_bytes, words

BASE_KINDS = ("email", "ip", "card", "phone")
CRF_KINDS = ("name", "national_phone", "id", "address", "birth")
TAGS = ["O", *[f"{b}-{k}" for k in CRF_KINDS for b in "BI"]]
LINE_END = frozenset(b".!?")

# The base patterns. A start inside a digit run can match only where the run's
# own start does, so the look-behind changes no result and keeps long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def _at_most_255(digits: str) -> bool:
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans in order of kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_at_most_255(p.lstrip("0")) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# --- training table -----------------------------------------------------------------------


#: Forms of sentences in four languages; in an entity ``=`` marks a word that stands as it is.
SENTENCES = {
    "en": [
        "w w with {name:N N} about w w", "my name is {name:N} and w w", "I am {name:N N}, w w", "w w {name:=Mr. N} w w w", "the letter was written by {name:N N} w w", "regards, {name:N N}", "she lives at {address:ddd N =Street} w w",
        "our office is at {address:dd N =Road} w", "w moved to {address:dddd N =Avenue} w w", "born on {birth:dd/dd/dddd}, w w", "her date of birth is {birth:dddd-dd-dd} w", "my passport number is {id:Adddddddd} w", "w w social security number {id:ddd-dd-dddd} w", "call me on {national_phone:(ddd) ddd-dddd} w", "w w phone {national_phone:ddd-ddd-dddd} w w",
    ],
    "fr": [
        "je m'appelle {name:N N} et w w", "mon nom est {name:N N} w", "w w signé par {name:N N} w", "w w {name:=M. N} w w", "w w {name:=Mme N} w w", "Nom : {name:N N}", "cordialement, {name:N N}", "il habite au {address:dd =rue N} w w", "elle habite {address:dd =avenue =de N} w", "adresse : {address:d =rue =de =la N}",
        "né le {birth:dd/dd/dddd} w w", "née le {birth:dd.dd.dddd} w", "date de naissance : {birth:dd/dd/dddd}", "passeport n° {id:ddAAddddd} w", "mon numéro de passeport est {id:ddAAddddd} w w", "téléphone : {national_phone:0d dd dd dd dd}", "appelez le {national_phone:0d dd dd dd dd} w w", "tél. {national_phone:0d dd dd dd dd}",
    ],
    "de": [
        "mein Name ist {name:N N} und w w", "ich heiße {name:N N} w w", "w w {name:=Herr N} w w", "w w {name:=Frau N} w", "unterschrieben von {name:N N} w", "Name: {name:N N}", "grüße, {name:N N}", "er wohnt in der {address:~straße dd} w w", "sie wohnt in der {address:~gasse d} w", "Adresse: {address:~straße ddd}", "Anschrift: {address:~weg dd}",
        "geboren am {birth:dd.dd.dddd} in w", "Geburtsdatum: {birth:dd.dd.dddd}", "Reisepass {id:AddAdddddd} w w", "mein Reisepass hat die Nummer {id:AddAdddddd} w", "Telefon: {national_phone:0ddd ddddddd}", "Tel. {national_phone:0ddd ddddddd} w w", "erreichbar unter {national_phone:0ddd ddddddd} w",
    ],
    "es": [
        "me llamo {name:N N} y w w", "mi nombre es {name:N N} w", "w w {name:=Sr. N} w w", "w w {name:=Sra. N} w", "firmado por {name:N N} w w", "Nombre: {name:N N}", "saludos, {name:N N}", "vive en la {address:=calle N dd} w w", "w en {address:=calle N ddd} w", "dirección: {address:=avenida N dd}", "nacido el {birth:dd/dd/dddd} en w", "nacida el {birth:dd-dd-dddd} w", "fecha de nacimiento: {birth:dd/dd/dddd}",
        "DNI {id:ddddddddA} w w", "su DNI es {id:ddddddddA} w", "pasaporte {id:AAAdddddd} w", "teléfono: {national_phone:ddd ddd ddd}", "llame al {national_phone:ddd dd dd dd} w w", "mi móvil es {national_phone:ddd ddd ddd} w",
    ],
}
#: What looks alike and is none: capitals, repeats, places, counts and prices in prose.
OTHERS = [
    "R R R R R R R R", "R R R R w w", "w w. R R R R R", "R R R R R R R R. w w w", "S S T T w w w w", "U U U U w", "U w U w. U", "U U w w w w w", "N w w w w w w. N w w w", "w w N w w N N w w w", "w w w in N w w w", "w the N N of w w", "w w dd w ddd w w", "w from dddd to dddd w", "w w d.ddd w w dd,dd w",
    "N w w, w N w w. N w", "w the street w the road w", "la rue w w w", "die Straße w w w", "la calle w w w", "w w w dd dd w w", "w on dd/dd/dddd w w", "w w am dd.dd.dddd w w", "w le dd/dd/dddd w w", "w el dd/dd/dddd w", "number dddddd w w", "w ddd ddd w w", "page dd N w w", "chapter d N w", "w w w ddddddd w", "w N dd w w", "N dd, w w", "w w with N w w w", "w name w w w", "w w phone w w w", "A A A A A A A A", "w w w. L. N w w w", "w L. N w w", "w w. L. N N w w", "w w w. C. C. N w w", "L. N w w w w",
]
#: Common words of the four languages.
PLAIN = {
    "en": "the of and to in that is was for it with as on be at by this have from or had not are but they which one you all were when we there been their has would what if more can out other into do time some could these two may then first any my now such like our over man even most after also many before must through back years where much your way well down should because each just those people how too little state good make world still own see work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split(),
    "fr": "le la les de des du et un une est que qui dans pour pas sur avec plus par mais nous vous ils elle son ses leur cette comme tout faire bien être avoir sans deux même aussi autre après temps jour très encore entre toujours alors fait peut quand sous monde ici depuis chaque rien moins avant ainsi grand petit jamais vers".split(),
    "de": "der die das und ist von zu mit den für auf nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können schon gegen vom jetzt immer seit wieder hier ohne etwas unter".split(),
    "es": "el la los de que y en un una por con no para su como más pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto antes algunos unos otro otras otra tanto esa estos mucho cual poco ella estar".split(),
}


def training_table(seed: int = 11, rounds: int = 8) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made from templates: (tokens, tags) of short sequences.

    ``{kind:text}`` marks an entity; d, A, a stand for a random digit, capital and small
    letter inside it; N is a capitalised name, C a short one, w a plain word, U one in capitals
    beyond ASCII, L a letter; R, S and T are each one word all through a sequence, and ``~`` begins a compound.
    """
    rng = random.Random(seed)
    language = "en"
    positive = [
        "contact {name:Mr. N N} for w w", "w w {name:Mrs. N N} w w", "please ask {name:Dr. N} about w", "my name is {name:N N} and w",
        "Name: {name:N N}", "w signed by {name:Ms. N N} on w", "call me at {national_phone:(ddd) ddd-dddd} w", "phone: {national_phone:ddd-ddd-dddd}",
        "tel {national_phone:0dd dddd dddd} w w", "my number is {national_phone:ddd.ddd.dddd} w", "mobile {national_phone:(ddd) ddd-dddd} or w",
        "SSN {id:ddd-dd-dddd} w", "w ssn: {id:ddd-dd-dddd} w w", "social security number {id:ddd-dd-dddd} w", "passport {id:Adddddddd} w", "passport no {id:AAddddddd} w",
        "IBAN {id:AAdd AAAA dddd dddd dddd dd} w", "iban: {id:AAdd dddd dddd dddd dddd dd}", "lives at {address:dd N Street} w w", "address: {address:ddd N Avenue} w",
        "w sent to {address:d N Road} w", "at {address:dddd N Lane} w", "born on {birth:dd/dd/dddd} in w", "DOB: {birth:dddd-dd-dd}", "date of birth {birth:dd.dd.dddd} w",
        "w w {national_phone:ddd-ddd-dddd} w w", "w {id:ddd-dd-dddd} w w w",
    ]
    negative = [
        "N w w w w w w.", "w w, w w w N w w.", "W W W!! W W!!", "w%%% w&&& w### w***", "version d.d.d of w", "w in dddd w w w", "page ddd of w w", "w costs $dd.dd w",
        "on dddd-dd-dd w w w", "dd/dd/dddd w w", "Licensed under CC BY-NC d.d.", "the GNU General Public License, version d.", "w | w | w | N |", "w w dd% w w ddd w",
        "w = \"aadaddaadadadd\" w", "dddddddddddddddd w w", "N w w N w, w N w.", "w street w w road w", "N N w w w.", "N. N w w w", "w w N. N w", "C. N w w, w", "w w C. C w w", "W%%% W&&& N### w*** w.$$$ N%%%", "w,&&& N$$$ w### C%%% w.***",
        "N.%%% N### w,&&& w$$$", "w.### N%%% w*** w$$$ w&&& N,### w%%%", "C.&&& N%%% w### C$$$ w***", "N! N w. N", "N, N. N", "w N | N | w | N. |", "w w ddd-dd w dddd", "call w w number w dd", "w +d w", "ddd.ddd w d.dd",
    ]

    def plain_word() -> str:
        return rng.choice(PLAIN[language]) if rng.random() < 0.6 else word()

    def word() -> str:
        return "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "ou", "la", "de", "es", "ch", "ei", "ra", "é", "ó", "ü"]) for _ in range(rng.randint(1, 4)))

    def fill(form: str) -> str:
        subs = {"d": lambda: rng.choice("0123456789"), "A": lambda: rng.choice("ABCDEFGHKLMNPRSTUVWXYZ"), "a": lambda: rng.choice("abcdef")}
        return "".join(subs[c]() if c in subs else c for c in form)

    def plain(token: str) -> str:
        core = re.match(r"[NCwWULRST]?", token).group()
        if core and re.fullmatch(r"[NCwWULRST][^A-Za-z0-9]*", token):
            capitals = "".join(rng.choice("ÑÉÀÜÇCIABOE") for _ in range(rng.randint(2, 5)))
            name = plain_word() if rng.random() < 0.3 else word()
            made = {"N": name.capitalize(), "C": word().capitalize()[:2], "w": plain_word(), "W": word().upper(), "U": capitals, "L": rng.choice("ABCDEFGHIJKLNOPQRSTUVWXYZ"), **same}[core]
            return made + token[1:]
        return fill(token) if re.search(r"d", token) and re.fullmatch(r"[\W\dda\"]+", token) else token

    rows = []
    for _ in range(rounds):
        many = [("en", f) for f in positive + negative * 2] + [(code, f) for code, forms in SENTENCES.items() for f in forms] + [(rng.choice(list(PLAIN)), f) for f in OTHERS * 3]
        for language, form in many:
            tokens, tags = [], []
            same = {c: rng.choice([word().capitalize(), plain_word().capitalize(), word(), rng.choice("AEOY")]) for c in "RST"}
            for m in re.finditer(r"\{(\w+):([^}]*)\}|(\S+)", form):
                if m[3]:
                    tokens.append(plain(m[3]))
                    tags.append("O")
                    continue
                for k, part in enumerate(m[2].split()):
                    fixed = part in ("Mr.", "Mrs.", "Ms.", "Dr.", "Street", "Avenue", "Road", "Lane")
                    made = part if fixed else part[1:] if part[0] == "=" else word().capitalize() + part[1:] if part[0] == "~" else None
                    tokens.append(made or (word().capitalize() if part == "N" else fill(part)))
                    tags.append(("B-" if not k else "I-") + m[1])
            if rng.random() < 0.3:
                tokens[-1] += rng.choice([".", ","])
            elif form in OTHERS and rng.random() < 0.35:  # junk marks after every word
                tokens = [t + rng.choice("%&#*$!?~^") * rng.randint(1, 3) for t in tokens]
            rows.append((tokens, tags))
    return rows


# --- features -----------------------------------------------------------------------------

_CLASS = np.arange(256, dtype=np.int64) + 16
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[~NON_SPACE] = 0
TEMPLATES = 11


def shape_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each token's shape: its runs of byte classes, digit runs with their length."""
    kind = _CLASS[data]
    fresh = np.empty(len(kind), bool)
    fresh[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh[start] = True
    run = np.flatnonzero(fresh)
    size = np.diff(np.append(run, len(kind)))
    code = kind[run]
    code = np.where(code == 3, 3 + 256 * np.minimum(size, 9), code)
    first, last = np.searchsorted(run, start), np.searchsorted(run, end)
    # A sum over a token's runs, each mixed with its place in the token.
    count = last - first
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    member = np.repeat(first, count) + place
    mixed = mix64(code[member].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
    return np.add.reduceat(mixed, np.cumsum(count) - count) if len(count) else np.empty(0, np.uint64)


def sequence_starts(block: Block, w) -> np.ndarray:
    """First token of each sequence: of a document, after a line break, after a sentence end."""
    n = len(w.start)
    first = np.zeros(n + 1, bool)
    first[w.doc_first] = True
    if n > 1:
        breaks = np.cumsum(block.data == 10)
        first[1:n] |= breaks[w.start[1:]] > breaks[w.end[:-1] - 1]
        first[1:n] |= np.isin(block.data[w.end[:-1] - 1], list(LINE_END)) & (w.end[:-1] - w.start[:-1] > 3)
    return np.flatnonzero(first[:n])


def token_features(block: Block, w, starts: np.ndarray) -> list[np.ndarray]:
    """One hash array for each template; neighbours beyond the sequence are 0."""
    shape = shape_hashes(block.data, w.start, w.end)
    n = len(shape)
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[starts] = True
    is_last[np.append(starts[1:], n) - 1] = True

    def before(x):
        out = np.zeros_like(x)
        out[1:] = x[:-1]
        out[is_first] = 0
        return out

    def after(x):
        out = np.zeros_like(x)
        out[:-1] = x[1:]
        out[is_last] = 0
        return out

    both = lambda a, b: mix64(a * np.uint64(3) + b)
    left, right = before(shape), after(shape)
    one, two = before(w.hash), before(before(w.hash))
    again = np.where((w.hash == one) | (w.hash == after(w.hash)), np.uint64(1), np.uint64(2))
    return [shape, left, right, both(left, shape), both(shape, right), w.hash, one, two, both(two, one), both(shape, again), after(w.hash)]


@dataclass
class Field:
    """A trained field: known feature hashes and weights by template, transitions."""

    known: list[np.ndarray]
    weights: list[np.ndarray]
    start: np.ndarray
    step: np.ndarray

    def emissions(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(features[0]), len(TAGS)), np.float32)
        for x, known, weights in zip(features, self.known, self.weights, strict=True):
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            hit = np.flatnonzero(known[at] == x)
            out[hit] += weights[at[hit]]
        return out

    def decode(self, features: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Best tag of each token by Viterbi, all sequences side by side."""
        n = len(features[0])
        if not n:
            return np.empty(0, np.int8)
        score = self.emissions(features)
        length = np.diff(np.append(starts, n))
        order = np.argsort(-length, kind="stable")
        first, length = starts[order], length[order]
        open_at = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # sequences with a t-th token
        back = np.zeros((n, len(TAGS)), np.int8)
        best = score[first] + self.start
        final = np.zeros((len(first), len(TAGS)), np.float32)
        step = np.ascontiguousarray(self.step.T)  # [to, from]
        for t in range(1, int(length[0])):
            live = open_at[t]
            final[live : len(best)] = best[live:]
            paths = best[:live, None, :] + step[None]
            choice = paths.argmax(2)
            back[first[:live] + t] = choice
            best = np.take_along_axis(paths, choice[:, :, None], 2)[:, :, 0] + score[first[:live] + t]
        final[: len(best)] = best
        tags = np.zeros(n, np.int8)
        now = final.argmax(1)
        tags[first + length - 1] = now
        for t in range(int(length[0]) - 1, 0, -1):
            live = open_at[t]
            now[:live] = back[first[:live] + t, tags[first[:live] + t]]
            tags[first[:live] + t - 1] = now[:live]
        return tags


def train(table: list[tuple[list[str], list[str]]] | None = None, steps: int = 120, ridge: float = 0.02) -> Field:
    """Maximise the table's penalised log-likelihood (adaptive gradient ascent)."""
    table = table or training_table()
    data, offsets = string_bytes(pa.array([" ".join(tokens) for tokens, _ in table], pa.string()))
    block = Block(0, len(table), data, offsets)
    w = words(block, NON_SPACE)
    starts = w.doc_first[:-1]
    features = token_features(block, w, starts)
    gold = np.array([TAGS.index(t) for _, tags in table for t in tags])
    if len(gold) != len(features[0]):
        raise ValueError("tokens of the training table must not hold white space")
    k, n = len(TAGS), len(gold)
    known = [np.unique(x) for x in features]
    column = [np.searchsorted(a, x) for a, x in zip(known, features, strict=True)]
    weights = [np.zeros((len(a), k)) for a in known]
    start, step = np.zeros(k), np.zeros((k, k))
    length = np.diff(w.doc_first)
    wide = int(length.max())
    spot = np.minimum(starts[:, None] + np.arange(wide), n - 1)
    valid = np.arange(wide) < length[:, None]
    hot = np.eye(k)[gold]
    pairs = np.zeros((k, k))
    inner = np.ones(n, bool)
    inner[starts] = False
    np.add.at(pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    params = [*weights, start, step]
    grown = [np.zeros_like(p) for p in params]

    def log_sum(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for _ in range(steps):
        score = sum(p[c] for p, c in zip(weights, column, strict=True))[spot]
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0] + start
        for t in range(1, wide):
            forward[:, t] = np.where(valid[:, t, None], log_sum(forward[:, t - 1, :, None] + step, 1) + score[:, t], forward[:, t - 1])
        for t in range(wide - 2, -1, -1):
            backward[:, t] = np.where(valid[:, t + 1, None], log_sum(step + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2), 0)
        total = log_sum(forward[:, -1], 1)
        belief = np.exp(forward + backward - total[:, None, None])
        gradient_pairs = pairs.copy()
        for t in range(1, wide):
            rows = valid[:, t]
            joint = forward[rows, t - 1, :, None] + step + (score[rows, t] + backward[rows, t])[:, None, :]
            gradient_pairs -= np.exp(joint - total[rows, None, None]).sum(0)
        miss = hot - belief[valid]
        gradients = []
        for p, c in zip(weights, column, strict=True):
            g = np.zeros_like(p)
            np.add.at(g, c, miss)
            gradients.append(g)
        gradients += [miss[starts].sum(0), gradient_pairs]
        for p, g, s in zip(params, gradients, grown, strict=True):
            g -= ridge * p
            s += g * g
            p += 0.5 * g / (np.sqrt(s) + 1e-8)
    return Field(known, [x.astype(np.float32) for x in weights], start.astype(np.float32), step.astype(np.float32))


def crf_spans(field: Field, block: Block) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each document of a block, in code points."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(block.n_docs)]
    w = words(block, NON_SPACE)
    if not len(w.start):
        return out
    starts = sequence_starts(block, w)
    tags = field.decode(token_features(block, w, starts), starts)
    begin = np.flatnonzero(tags % 2 == 1)
    if not len(begin):
        return out
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    first = np.zeros(len(tags) + 1, bool)
    first[starts] = True
    for i in begin.tolist():
        j, doc = i + 1, int(np.searchsorted(w.doc_first, i, "right")) - 1
        while j < len(tags) and not first[j] and tags[j] == tags[i] + 1:
            j += 1
        lo, hi = int(w.start[i]), int(w.end[j - 1])
        while hi > lo and not (block.data[hi - 1] >= 128 or chr(block.data[hi - 1]).isalnum()):
            hi -= 1
        while lo < hi and not (block.data[lo] >= 128 or chr(block.data[lo]).isalnum() or block.data[lo] == 40):
            lo += 1
        if lo < hi:
            base = points[block.offsets[doc]]
            out[doc].append((CRF_KINDS[(tags[i] - 1) // 2], int(points[lo] - base), int(points[hi] - base)))
    return out


def outside(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of ``taken``; both are put in order and met once."""
    if not taken or not spans:
        return spans
    starts, ends = [], []
    for s, e in sorted((s, e) for _, s, e in taken):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    # The last taken run that begins before a span's end must end at its start or before.
    last = np.searchsorted(starts, [e for _, _, e in spans], "left") - 1
    return [x for x, k in zip(spans, last.tolist(), strict=True) if k < 0 or ends[k] <= x[1]]


def span_lists(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    """An Arrow list of (kind, start, end) for each row."""
    flat = [s for row in rows for s in row]
    bounds = np.zeros(len(rows) + 1, np.int32)
    bounds[1:] = np.cumsum([len(row) for row in rows])
    columns = [pa.array([s[k] for s in flat], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, ["kind", "start", "end"]))


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_pii(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and spans (base first), arrays of (kind, start, end)."""
    docs = docs.drop("base_spans", "spans")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("base_spans", _SPAN), T.StructField("spans", _SPAN)])
    shared = docs.sparkSession.sparkContext.broadcast(field or train())

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(at)):
                base = [base_spans(block.text(i).decode()) for i in range(block.n_docs)]
                spans = []
                for b, more in zip(base, crf_spans(shared.value, block), strict=True):
                    spans.append(b + sorted(outside(more, b), key=lambda m: (CRF_KINDS.index(m[0]), m[1])))
                yield pa.RecordBatch.from_arrays([*batch.slice(block.first, block.n_docs).columns, span_lists(base), span_lists(spans)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )
