"""A deal said in one sentence, read into seller, buyer, goods, quantity, unit and rate.

Each word gets a letter for what it can be; patterns over the string of letters then say which words are which.
Letters: c code, d digits, e digits of two at most, n number word, u unit, s and b words after a seller or a buyer,
F and T words before one, r word beside a rate, k other grammar, w any other word; c and w in upper case end a clause.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import NUMBER_WORDS, SCALES
from .matching import ratio

# The words of spoken deals, in Latin letters.
UNITS = {
    "bori": "BAGS", "bora": "BAGS", "boris": "BAGS", "poti": "BAGS", "goni": "BAGS", "bag": "BAGS", "bags": "BAGS", "katta": "BAGS", "kg": "KGS", "kgs": "KGS", "kilo": "KGS", "kilos": "KGS", "kilogram": "KGS", "quintal": "QTL", "quintals": "QTL", "qtl": "QTL",
    "ton": "MT", "tons": "MT", "tonne": "MT", "mt": "MT", "peti": "BOX", "petti": "BOX", "box": "BOX", "boxes": "BOX", "carton": "BOX", "pcs": "PCS", "piece": "PCS", "pieces": "PCS", "nag": "PCS",
}
GRAMMAR = {
    "se": "s", "si": "s", "kadun": "s", "kadoon": "s", "pasethi": "s", "ne": "s", "ko": "b", "la": "b", "from": "F", "by": "F", "to": "T", "sold": "k", "bought": "k", "becha": "k", "liya": "k", "diya": "k",
    "mein": "r", "me": "r", "rate": "r", "bhav": "r", "bhaav": "r", "darane": "r", "dar": "r", "rupees": "r", "rupee": "r", "rs": "r", "rs.": "r", "per": "r", "@": "r", "ke": "r", "ka": "r", "ki": "r", "price": "r", "at": "r", "prati": "r", "each": "r",
    "से": "s", "सी": "s", "कडून": "s", "कदुन": "s", "પાસેથી": "s", "ने": "s", "ને": "s", "को": "b", "ला": "b", "में": "r", "रेट": "r", "भाव": "r", "दर": "r", "रुपये": "r", "का": "r", "के": "r", "की": "r", "ભાવ": "r", "રૂપિયા": "r", "बेचा": "k", "लिया": "k", "दिया": "k",
}
#: Marks the seller in Hindi and Marathi, but the buyer in Gujarati: where no other word marks a buyer, it does.
AMBIGUOUS = ("ne", "ने", "ને")
FILLERS = "haan han ha haa ji achha accha acha theek thik hai he tha thi bas matlab yaar arre are suno sun sunno dekho dekh bol bolo boliye likh likho lo karo kar kro note entry kya na nahi abhi chalo sahi badhiya chalega daal daalo bhai sir madam aur phir fir toh wo woh ye yeh ekdum zara jara okay ok so um uh er erm hmm well right yeah yes no please thanks thank done write put record book add make just actually basically like now then and the a an of is it listen this that here there down up let lets also second minute wait"
PHRASES = "likh do|kar do|daal do|ek minute|hold on"
HINDI = {
    "ek": 1, "do": 2, "teen": 3, "tin": 3, "char": 4, "chaar": 4, "panch": 5, "paanch": 5, "che": 6, "chhe": 6, "saat": 7, "sat": 7, "aath": 8, "ath": 8, "nau": 9, "nav": 9, "das": 10, "dus": 10, "gyarah": 11, "akara": 11, "barah": 12, "bara": 12, "terah": 13, "tera": 13,
    "chaudah": 14, "chauda": 14, "pandrah": 15, "pandra": 15, "solah": 16, "sola": 16, "satrah": 17, "satra": 17, "atharah": 18, "athara": 18, "unnis": 19, "bees": 20, "bis": 20, "vees": 20, "tees": 30, "tis": 30, "chalis": 40, "chalees": 40, "pachas": 50, "pachaas": 50,
    "pannas": 50, "saath": 60, "sath": 60, "sattar": 70, "assi": 80, "nabbe": 90, "navvad": 90,
}
HINDI_SCALES = {"hundred": 100, "sau": 100, "so": 100, "she": 100, "hazaar": 1000, "hazar": 1000}
# Numbers and units in Devanagari and Gujarati letters; those that aren't here are spelled in Latin ones.
INDIC = {
    "एक": 1, "दो": 2, "दोन": 2, "तीन": 3, "चार": 4, "पांच": 5, "पाँच": 5, "पाच": 5, "छह": 6, "छः": 6, "सहा": 6, "सात": 7, "आठ": 8, "नौ": 9, "नऊ": 9, "दस": 10, "दहा": 10, "ग्यारह": 11, "बारह": 12, "तेरह": 13, "चौदह": 14, "पंद्रह": 15, "सोलह": 16, "सत्रह": 17, "अठारह": 18, "उन्नीस": 19,
    "बीस": 20, "वीस": 20, "तीस": 30, "चालीस": 40, "चाळीस": 40, "पचास": 50, "पन्नास": 50, "साठ": 60, "सत्तर": 70, "अस्सी": 80, "नब्बे": 90, "नव्वद": 90,
    "બે": 2, "ત્રણ": 3, "ચાર": 4, "પાંચ": 5, "છ": 6, "સાત": 7, "આઠ": 8, "નવ": 9, "દસ": 10, "વીસ": 20, "ત્રીસ": 30, "ચાલીસ": 40, "પચાસ": 50, "સાઠ": 60, "સિત્તેર": 70, "એંસી": 80, "નેવું": 90,
}
INDIC_SCALES = {"सौ": 100, "शे": 100, "हज़ार": 1000, "हजार": 1000, "लाख": 100_000, "સો": 100, "હજાર": 1000, "લાખ": 100_000}
INDIC_UNITS = {"बोरी": "BAGS", "पोती": "BAGS", "गोणी": "BAGS", "किलो": "KGS", "क्विंटल": "QTL", "टन": "MT", "पेटी": "BOX", "બોરી": "BAGS", "કિલો": "KGS", "ક્વિન્ટલ": "QTL", "પેટી": "BOX"}
INDIC_GOODS = {"काजू": "Cashew", "बादाम": "Almond", "अखरोट": "Walnut", "पिस्ता": "Pistachio", "किशमिश": "Raisin", "हल्दी": "Turmeric", "हळद": "Turmeric", "जीरा": "Cumin", "इलायची": "Cardamom", "કાજુ": "Cashew", "બદામ": "Almond", "હળદર": "Turmeric", "જીરું": "Cumin"}
PAIRS = {"kali mirch": "Black pepper", "काली मिर्च": "Black pepper"}
QUALIFIERS = {
    "sabut": "whole", "साबुत": "whole", "tukda": "split", "टुकड़ा": "split", "dal": "split", "gola": "ball", "गोला": "ball", "chota": "small", "छोटा": "small", "lahan": "small",
    "bada": "large", "बड़ा": "large", "mota": "large", "मोटा": "large", "naya": "new", "नया": "new", "juna": "old", "पुराना": "old",
}
GOODS = {"cashew": "Cashew", "almond": "Almond", "walnut": "Walnut", "pistachio": "Pistachio", "raisin": "Raisin", "fig": "Fig", "turmeric": "Turmeric", "cumin": "Cumin", "cardamom": "Cardamom", "kaju": "Cashew", "badam": "Almond", "akhrot": "Walnut", "pista": "Pistachio", "kishmish": "Raisin", "khajur": "Dates", "anjeer": "Fig", "haldi": "Turmeric", "halad": "Turmeric", "jeera": "Cumin", "elaichi": "Cardamom"}
#: Least likeness of a misheard word after a number to a unit; words of a party at most.
UNIT_LIKE, PARTY_WORDS = 62.0, 3
FIELDS = {"seller": "string", "buyer": "string", "goods": "string", "quantity": "double", "uom": "string", "rate": "double", "leftover": "string"}
CODE = r"[A-Za-z]{1,3}\d{1,4}"
DIGITS = str.maketrans("०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯", "01234567890123456789")
MARKED = re.compile(r"(?P<back>(?:(?:ww|cw|w|c)?[wW]|[cC]))(?P<after>[sb])|(?P<before>[FT])(?=(?P<fore>[cC]|W|w(?:[cC]|W|w[cCwW]?)?))")
NUMBER = re.compile(r"[de]e{0,2}|n+")


@dataclass
class Lexicon:
    """Word tables; those of another language or script can take their place."""

    units: dict[str, str] = field(default_factory=lambda: UNITS | INDIC_UNITS)
    grammar: dict[str, str] = field(default_factory=lambda: dict(GRAMMAR))
    ambiguous: frozenset[str] = frozenset(AMBIGUOUS)
    fillers: frozenset[str] = frozenset(FILLERS.split())
    numbers: dict[str, int] = field(default_factory=lambda: NUMBER_WORDS | HINDI | INDIC)
    scales: dict[str, int] = field(default_factory=lambda: SCALES | HINDI_SCALES | INDIC_SCALES)
    goods: dict[str, str] = field(default_factory=lambda: QUALIFIERS | GOODS | INDIC_GOODS)
    pairs: dict[str, str] = field(default_factory=lambda: dict(PAIRS))

    def term(self, said: str) -> str:
        """Goods in English: terms of two words first, then single ones; a word that isn't known stays as it is."""
        words, out = said.split(), []
        while words:
            pair = self.pairs.get(" ".join(map(bare, words[:2])))
            out.append(pair or self.goods.get(bare(words[0]), words[0]))
            words = words[2 if pair else 1 :]
        return " ".join(out)

    def is_known(self, said: str | None) -> bool:
        """Whether any word of it is of the trade."""
        return any(bare(w) in self.goods for w in (said or "").split())

    def known(self, word: str) -> bool:
        return any(word in t for t in (self.units, self.grammar, self.numbers, self.scales))


def bare(token: str) -> str:
    return token.strip(".,:;!?₹$£€'\"").lower()


def tokens(sentence: str, lex: Lexicon) -> list[str]:
    """The words that count: codes in one piece, fillers left out."""
    text = re.sub(r"(?<=[A-Za-z])-(?=[A-Za-z])", " ", sentence)
    text = re.sub(rf"\b({CODE})[-/]({CODE})\b", r"\1 \2", text)
    text = re.sub(r"(?<!\S)([A-Za-z]{1,3})[-\s](\d{1,3})(?=[.,]?(?:\s|$))(?=[.,]?\s*(\S*))", lambda m: m[0] if lex.known(m[1].lower()) or bare(m[3]) in lex.units else m[1] + m[2], text)
    text = re.sub(rf"(?i)(?<!\S)(?:{PHRASES})(?!\S)", " ", text)
    return [t for t in text.split() if not (bare(t) in lex.fillers and bare(t) not in lex.numbers | lex.scales)]


def letter(token: str, lex: Lexicon) -> str:
    word, ends = bare(token), token[-1] in ",.;!?"
    if re.fullmatch(CODE, word, re.I):
        return "C" if ends else "c"
    digits = word.replace(",", "")
    if re.fullmatch(r"\d+(?:\.\d+)?", digits):
        return "e" if len(digits) <= 2 else "d"
    if word in lex.numbers or word in lex.scales:
        return "n"
    if word in lex.units or word in lex.grammar:
        return "u" if word in lex.units else lex.grammar[word]
    plain = any(map(str.isalnum, word)) and not any(map(str.isdigit, word))  # marks within Indic words are no letters
    return ("W" if ends else "w") if plain else "."


def said_number(words: list[str], lex: Lexicon) -> float | None:
    """Number words: added up by scales, or, without one, read off group by group (tens take a unit)."""
    if any(w in lex.scales for w in words):
        total, block = 0, 0
        for w in words:
            scale = lex.scales.get(w)
            if scale == 100:
                block = max(block, 1) * 100
            elif scale:
                total, block = total + max(block, 1) * scale, 0
            else:
                block += lex.numbers[w]
        return float(total + block)
    groups: list[int] = []
    for w in words:
        v = lex.numbers[w]
        if groups and groups[-1] >= 20 and groups[-1] % 10 == 0 and 0 < v < 10:
            groups[-1] += v
        else:
            groups.append(v)
    return float("".join(map(str, groups))) if groups else None


def unit(token: str, lex: Lexicon) -> str | None:
    """The unit a word after a number is, or was misheard from."""
    word = bare(token)
    if word in lex.units or len(word) < 3 or re.search(r"\d", word):
        return lex.units.get(word)
    like, best = max((ratio(word, u), u) for u in lex.units)
    return lex.units[best] if like >= UNIT_LIKE else None


def name(words: list[str]) -> str | None:
    text = " ".join(words).strip(".,:;!? ")
    return (text.upper() if re.fullmatch(CODE, text) else text) or None


def read(sentence: str | None, lex: Lexicon) -> dict[str, object]:
    """The columns of a deal; a part that wasn't heard is null, as all are for a null or empty sentence."""
    words = tokens((sentence or "").translate(DIGITS), lex)
    tags = "".join(letter(t, lex) for t in words)
    if "b" not in tags:
        tags = "".join("b" if bare(t) in lex.ambiguous else tag for t, tag in zip(words, tags, strict=True))
    out: dict[str, object] = dict.fromkeys(FIELDS)
    left = list(tags)  # what no column has claimed

    def claim(role: str, a: int, b: int, value: object) -> None:
        out[role] = value
        left[a:b] = "." * (b - a)

    for m in MARKED.finditer(tags):
        part, mark = ("back", m["after"]) if m["after"] else ("fore", m["before"])
        role = "seller" if mark in "sF" else "buyer"
        if out[role] is None:
            a, b = m.span(part)
            claim(role, a, b, name(words[a:b]))
            left[m.start("after" if m["after"] else "before")] = "."
    for m in re.finditer("[cC]", "".join(left)):
        role = next((r for r in ("seller", "buyer") if out[r] is None), None)
        if role:
            claim(role, m.start(), m.end(), name([words[m.start()]]))

    rest = "".join(left)
    found = []
    for m in NUMBER.finditer(rest):
        part = [bare(t).replace(",", "") for t in words[m.start() : m.end()]]
        found.append((m.start(), m.end(), said_number(part, lex) if rest[m.start()] == "n" else float("".join(part) if len(part) > 1 else part[0])))
    follows = lambda n: unit(words[n[1]], lex) if n[1] < len(words) and left[n[1]] in "uwW" else None
    beside = lambda n: "r" in rest[max(0, n[0] - 1) : n[0]] + rest[n[1] : n[1] + 1]
    quantity = next((n for n in found if follows(n)), None)
    rate = next((n for n in found if n is not quantity and beside(n)), None)
    others = [n for n in found if n is not quantity and n is not rate]
    if quantity is None and others:
        quantity = others.pop(0)
    if rate is None and others:
        rate = others.pop(0)
    pivot = min((n[0] for n in (quantity, rate) if n), default=len(words))
    if quantity:
        out["uom"] = follows(quantity)
        claim("quantity", quantity[0], quantity[1] + (out["uom"] is not None), quantity[2])
    if rate:
        dictated = re.fullmatch(r"(\d{1,2})\.(\d{2})", bare(words[rate[0]])) if rate[1] - rate[0] == 1 else None
        claim("rate", rate[0], rate[1], float(dictated[1] + dictated[2]) if dictated else rate[2])

    runs = [m.span() for m in re.finditer("w*W|w+", "".join(left))]
    slots = [r for r in ("seller", "buyer") if out[r] is None]
    early = [r for r in runs if r[1] <= pivot]
    while len(early) > 1 and sum(b - a for a, b in early[1:]) >= len(slots):
        early = early[1:]  # the deal is next to its figures; what is said before it isn't of it
    spans: list[tuple[int, int]] = []
    for i, (a, b) in enumerate(early):
        shares = min(b - a, max(1, len(slots) - len(spans) - (len(early) - i - 1)))
        cuts = [a + -(-(b - a) * k // shares) for k in range(shares + 1)]
        spans += list(zip(cuts, cuts[1:], strict=False))
    for role, (a, b) in zip(slots, spans, strict=False):
        b = min(b, a + PARTY_WORDS)
        claim(role, a, b, name(words[a:b]))
    free = [m.span() for m in re.finditer("w*W|w+", "".join(left))]
    goods = next((r for r in free if r[1] > pivot), free[0] if free else None)
    if goods:
        heard = name(words[slice(*goods)])
        claim("goods", *goods, lex.term(heard or "") or None)
    out["leftover"] = " ".join(w for w, t in zip(words, left, strict=True) if t in "wWcCdenu") or None
    return out


ROLES = {"c": "code", "C": "code", "d": "number", "e": "number", "n": "number", "u": "unit", "s": "marks a seller", "b": "marks a buyer", "F": "before a seller", "T": "before a buyer", "r": "beside a rate", "k": "grammar", "w": "name or goods", "W": "name or goods", ".": "nothing"}


def explained(sentences: DataFrame, text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """sentences with a row a word that counts: place (from 1), word and what it was taken for."""
    lex = lexicon or Lexicon()

    @F.pandas_udf("array<struct<place:int,word:string,role:string>>")
    def roles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                words = tokens((t or "").translate(DIGITS), lex)
                tags = [letter(w, lex) for w in words]
                tags = tags if "b" in tags else ["b" if bare(w) in lex.ambiguous else x for w, x in zip(words, tags, strict=True)]
                out.append([{"place": i, "word": w, "role": ROLES[x]} for i, (w, x) in enumerate(zip(words, tags, strict=True), 1)])
            yield pd.Series(out, index=batch.index)

    return sentences.withColumn("_w", F.explode(roles(F.col(text)))).select(*(c for c in sentences.columns if c not in ("place", "word", "role")), "_w.*")


def deals(sentences: DataFrame, text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """sentences with the columns of FIELDS, which replace others of those names; reading is on Arrow batches."""
    lex = lexicon or Lexicon()
    kind = ", ".join(f"{f} {k}" for f, k in FIELDS.items())

    @F.pandas_udf(kind)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([read(t, lex) for t in batch], columns=list(FIELDS), index=batch.index)

    out = sentences.withColumn("_deal", parsed(F.col(text)))
    return out.select(*(c for c in sentences.columns if c not in FIELDS), "_deal.*")
