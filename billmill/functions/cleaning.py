"""Cleaners of printed values, as column expressions: amounts, dates, identifiers, names, units, words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the numbers, units, states and forms of names on Indian bills are.
STATES = {
    "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana", "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh", "13": "Nagaland",
    "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya", "18": "Assam", "19": "West Bengal", "20": "Jharkhand", "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat", "25": "Daman and Diu",
    "26": "Dadra and Nagar Haveli and Daman and Diu", "27": "Maharashtra", "29": "Karnataka", "30": "Goa", "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry", "35": "Andaman and Nicobar Islands", "36": "Telangana", "37": "Andhra Pradesh", "38": "Ladakh", "97": "Other Territory",
}
UNITS = {
    "kg": "KGS", "kgs": "KGS", "kilogram": "KGS", "kilograms": "KGS", "kilo": "KGS", "kgm": "KGS", "qtl": "QTL", "quintal": "QTL", "ton": "MTS", "tons": "MTS", "mt": "MTS", "mts": "MTS", "tonne": "MTS", "tonnes": "MTS",
    "gm": "GMS", "gms": "GMS", "gram": "GMS", "grams": "GMS", "pcs": "PCS", "pc": "PCS", "piece": "PCS", "pieces": "PCS", "nos": "PCS", "no": "PCS", "unit": "PCS", "units": "PCS", "each": "PCS", "box": "BOX", "boxes": "BOX",
    "ctn": "CTN", "carton": "CTN", "cartons": "CTN", "bag": "BAG", "bags": "BAG", "pkt": "PKT", "packet": "PKT", "packets": "PKT", "tin": "TIN", "tins": "TIN", "ltr": "LTR", "litre": "LTR", "litres": "LTR", "liter": "LTR", "l": "LTR",
    "mtr": "MTR", "meter": "MTR", "metre": "MTR", "sqft": "SQF", "sqm": "SQM",
}
LEGAL_FORMS = r"(?i)\b(private|pvt|limited|ltd|llp|inc|corporation|corp|company|co|enterprises?|enterprise|traders?|trading|industries|industry|agro|exports?|imports?|impex|and|&|the|m/s|messrs)\b"
ABBREVIATIONS = {
    "pvt": "private", "pv": "private", "ltd": "limited", "lmtd": "limited", "co": "company", "corp": "corporation", "inc": "incorporated", "ent": "enterprises", "enterprise": "enterprises", "inds": "industries", "ind": "industries", "industry": "industries",
    "exp": "exports", "export": "exports", "imp": "imports", "import": "imports", "trader": "traders", "trdrs": "traders", "agencies": "agency", "bros": "brothers", "mfg": "manufacturing", "intl": "international", "&": "and", "ms": "", "messrs": "",
}
CATEGORIES = [("almond", "Almonds"), ("badam", "Almonds"), ("walnut", "Walnuts"), ("akhrot", "Walnuts"), ("cashew", "Cashew"), ("kaju", "Cashew"), ("pistachio", "Pistachio"), ("pista", "Pistachio"), ("raisin", "Raisins"), ("kishmish", "Raisins"), ("date", "Dates"), ("khajur", "Dates"), ("fig", "Figs"), ("anjeer", "Figs"), ("apricot", "Apricot"), ("hazelnut", "Hazelnut"), ("packing", "Charges"), ("labour", "Charges"), ("freight", "Charges")]
BILL_WORDS = [
    "invoice", "total", "gst", "gstin", "tax", "hsn", "amount", "rate", "quantity", "qty", "date", "bill", "party", "state", "sac", "cgst", "sgst", "igst", "buyer", "seller", "consignee", "address", "pan", "eway", "e-way", "supply", "goods", "description", "value", "signatory",
]
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fourty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
SCALES = {"thousand": 10**3, "lakh": 10**5, "lakhs": 10**5, "lac": 10**5, "lacs": 10**5, "crore": 10**7, "crores": 10**7, "arab": 10**9, "arabs": 10**9}


def lookup(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def amount(c: Column) -> Column:
    """A printed figure as decimal(38,6): Indian grouping, (1,234.00), (-) and currency words; null if it is none."""
    text = F.trim(c)
    wrapped = text.rlike(r"^\(.*\)$")
    inner = F.when(wrapped, F.regexp_replace(text, r"^\(|\)$", "")).otherwise(text)
    marked = inner.contains("(-)") | inner.contains("(–)")
    bare = F.regexp_replace(inner, r"\((?:-|–)\)", "")
    bare = F.regexp_replace(bare, r"(?i)\b(?:inr|rs\.?|rupees?)\b|[₹$]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "[–—]", "-"), r"[^\d.\-]", "")
    bare = F.when(bare.startswith("-"), bare).otherwise(F.regexp_replace(bare, "-", ""))
    value = F.when(bare.rlike(r"^-?(?:\d+\.?\d*|\.\d+)$"), bare).try_cast("decimal(38,6)")
    return F.when((wrapped | marked) & (value > 0), -value).otherwise(value)


MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
YEAR = r"(\d{4}|\d{2})(?!\d)"
#: Years of two digits from this one on are of the last century.
PIVOT = 76
#: Shapes of a date within a text, in the order they are looked for, and which groups are its day, month and year.
DATES = [
    (rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[\s\-/.,]*(?:of\s+)?{MONTH}[\s\-/.,']*{YEAR}", (1, 2, 3)),
    (rf"(?<![a-z]){MONTH}[\s\-.]*(\d{{1,2}})(?:st|nd|rd|th)?[\s,\-/]+{YEAR}", (2, 1, 3)),
    (rf"(?<!\d)(\d{{1,2}})[/.\-\s](\d{{1,2}})[/.\-\s]{YEAR}", (1, 2, 3)),
    (r"(?<!\d)(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", (2, 3, 1)),
]


def date(c: Column) -> Column:
    """A printed date, day first but for ISO, anywhere in a text; where the day's and the month's places only make
    sense the other way round, they are. A time of day after it doesn't count; null if there is none."""
    months = lookup({m: str(i) for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)})

    def made(day: Column, month: Column, year: Column) -> Column:
        full = F.when(F.length(year) == 4, year).when(year.cast("int") < PIVOT, F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
        return F.try_to_date(F.concat_ws("-", full, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    def shape(text: Column, pattern: str, places: tuple[int, int, int]) -> Column:
        day, month, year = (F.regexp_extract(text, pattern, i) for i in places)
        either = made(day, months[month], year) if MONTH in pattern else F.coalesce(made(day, month, year), made(month, day, year))
        return F.when(text.rlike(pattern), either)

    def read(text: Column) -> Column:
        iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).otherwise(F.coalesce(*(shape(text, *d) for d in DATES)))

    trimmed = F.lower(F.trim(F.regexp_replace(F.trim(c), r"(?i)\s+\d{1,2}:\d{2}(:\d{2})?\s*([ap]m)?$", "")))
    return F.get(F.transform(F.array(trimmed), read), F.lit(0))  # so that the text is made once


def percent(c: Column) -> Column:
    """A printed rate: the figure without its sign, as it stands (0.05 stays 0.05)."""
    return amount(F.regexp_replace(c, "%", ""))


def plain_script(c: Column) -> Column:
    """Devanagari and Gujarati digits as ASCII ones, letters with a dot below as those without, and no accents."""
    digits = F.translate(c, "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯", "01234567890123456789")
    dotted = F.translate(F.regexp_replace(digits, "[\u093c\u0abc\u0300-\u036f]", ""), "\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f", "\u0915\u0916\u0917\u091c\u0921\u0922\u092b\u092f")
    return F.translate(dotted, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def alnum_upper(c: Column) -> Column:
    """Letters and digits in upper case, null if none are left: identifiers of taxpayers and vehicles."""
    return blank_to_null(F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", "")))


DIGITS36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def place(sign: Column) -> Column:
    """From 1, where a sign is among the base-36 digits; 0 if it isn't there."""
    return F.array_position(F.array(*map(F.lit, DIGITS36)), sign)


def check_digit(g: Column) -> Column:
    """The 15th sign that a taxpayer number's first 14 call for; null for a sign that isn't base 36."""
    products = [(place(F.substring(g, i, 1)) - 1) * (1 if i % 2 else 2) for i in range(1, 15)]
    total = reduce(lambda a, b: a + b, (F.floor(p / 36) + p % 36 for p in products))
    known = g.rlike("^[0-9A-Z]{14}")
    return F.when(known, F.element_at(F.array(*map(F.lit, DIGITS36)), ((36 - total % 36) % 36 + 1).cast("int")))


def checksum_ok(c: Column) -> Column:
    return F.coalesce((F.length(c) == 15) & (check_digit(c) == F.substring(c, 15, 1)), F.lit(False))


def gstin_problems(c: Column) -> Column:
    """What is wrong with a cleaned taxpayer number: its length, or else its pattern, state and checksum."""
    short = F.length(c) != 15
    rest = [F.when(~c.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"), "pattern"), F.when(~F.substring(c, 1, 2).isin(*STATES), "state"), F.when(~checksum_ok(c), "checksum")]
    return F.when(c.isNull(), F.array().cast("array<string>")).when(short, F.array(F.lit("length"))).otherwise(F.filter(F.array(*rest), lambda x: x.isNotNull()))


def unit(c: Column) -> Column:
    text = F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    known = lookup(UNITS)
    return F.when(text != "", F.coalesce(known[text], F.substring(F.upper(text), 1, 12)))


def hsn(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    padded = F.when(F.length(digits).isin(3, 5, 7), F.concat(F.lit("0"), digits)).otherwise(digits)
    return blank_to_null(F.substring(padded, 1, 12))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def name_key(c: Column) -> Column:
    """A party's name without its legal form: a key for candidates."""
    return squeezed(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), LEGAL_FORMS, " "))


def name_light(c: Column) -> Column:
    """A party's name with its abbreviations spelled out."""
    words = F.split(squeezed(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", " and ")), " ")
    return F.array_join(F.filter(F.transform(words, lambda w: F.coalesce(lookup(ABBREVIATIONS)[w], w)), lambda w: w != ""), " ")


def product_key(c: Column) -> Column:
    return squeezed(F.lower(F.coalesce(c, F.lit(""))))


def product_label(name: Column, grade: Column) -> Column:
    """A line's name with its grade, unless the name has it."""
    has = product_key(name).contains(product_key(grade))
    return F.when(grade.isNull() | has, F.coalesce(name, F.lit(""))).otherwise(F.trim(F.concat_ws(" ", name, grade)))


def category(key: Column, code: Column) -> Column:
    out = reduce(lambda acc, kv: acc.when(key.contains(kv[0]), kv[1]), CATEGORIES[1:], F.when(key.contains(CATEGORIES[0][0]), CATEGORIES[0][1]))
    return out.when(code.startswith("0802"), "Nuts").when(code.startswith("08"), "Dry Fruits")


def indian(c: Column) -> Column:
    """12,34,567.00 for a decimal of two places."""
    text = F.abs(c).cast("decimal(20,2)").cast("string")
    whole, part = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"(\.\d+)$", 1)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.regexp_replace(whole, r"(?<=\d)(?=(\d\d)*\d{3}$)", ","), part)


def words_value(text: Column) -> Column:
    """A number in Indian words, with hundreds, lakhs and crores; null if no number word occurs."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    units, scales = lookup(NUMBER_WORDS), lookup(SCALES)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("cur"), F.lit(False).alias("seen"))
    some = lambda a: F.when(a["cur"] == 0, F.lit(1).cast("long")).otherwise(a["cur"])

    def fold(a: Column, t: Column) -> Column:
        u, s = units[t].cast("long"), scales[t].cast("long")
        total = F.when(s.isNotNull(), a["total"] + some(a) * s).otherwise(a["total"])
        cur = F.when(u.isNotNull(), a["cur"] + u).when(t == "hundred", some(a) * 100).when(s.isNotNull(), F.lit(0).cast("long")).otherwise(a["cur"])
        return F.struct(total.alias("total"), cur.alias("cur"), (a["seen"] | u.isNotNull() | s.isNotNull() | (t == "hundred")).alias("seen"))

    return F.aggregate(tokens, start, fold, lambda a: F.when(a["seen"], a["total"] + a["cur"]))


def words_amount(text: Column) -> Column:
    """An amount in words as decimal(20,2): a label before it doesn't count, and paise are what comes between the last
    'and' and 'paise', or after 'rupees and' if rupees came before; null if no number word occurs."""
    made = F.transform(F.array(F.regexp_replace(F.lower(text), r"^.*?\bwords?\b\s*[:\-]?", "")), _words_amount)
    return F.get(made, F.lit(0))  # so that the text is made once


def _words_amount(low: Column) -> Column:
    head = F.regexp_extract(low, r"(?s)^(.*)pais[ea]", 1)
    split = head.contains(" and ")
    tail = r"\brupees?\b\s+and\s+(.+?)(?:\bonly\b|$)"
    before = F.regexp_extract(low, r"(?s)^(.*?)" + tail, 1)
    marked, implied = low.rlike("pais[ea]"), low.rlike(tail) & words_value(before).isNotNull()
    rupees = F.when(marked & split, F.regexp_extract(head, r"(?s)^(.*) and ", 1)).when(marked, head).when(implied, before).otherwise(low)
    paise = F.when(marked & split, F.regexp_extract(head, r"(?s)^.* and (.*)$", 1)).when(~marked & implied, F.regexp_extract(low, tail, 1))
    both = F.transform(F.array(rupees, paise), words_value)
    return (F.get(both, F.lit(0)).cast("decimal(18,0)") + F.coalesce(F.get(both, F.lit(1)), F.lit(0)).cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")


def due_date(day: Column, terms: Column) -> Column:
    days = blank_to_null(F.regexp_extract(terms, r"(?i)(\d+)\s*(?:days?|d)\b", 1)).try_cast("int")
    return F.when(days.isNotNull(), F.date_add(day, days))


def text_score(c: Column) -> Column:
    """How likely a text layer is real text, 0 to 1: bill words, letters, words with vowels.

    Letters are counted by what taking them away leaves, and words by splitting at what is no letter: no pattern looks
    around itself.
    """
    low = F.lower(c)
    hits = reduce(lambda a, b: a + b, (F.when(low.contains(w), 1).otherwise(0) for w in BILL_WORDS))
    bare = F.length(F.regexp_replace(c, r"(?U)\s+", ""))
    letters = bare - F.length(F.regexp_replace(c, r"(?U)[\s\p{L}]+", ""))
    tokens, vowels = F.regexp_count(c, F.lit("[A-Za-z]{2,}")), F.regexp_count(c, F.lit("[AEIOUaeiou][A-Za-z]+|[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]+[AEIOUaeiou][A-Za-z]*"))
    score = 0.5 * F.least(hits / 8.0, F.lit(1.0)) + 0.2 * F.least(letters / bare / 0.45, F.lit(1.0)) + 0.3 * F.when(tokens > 0, vowels / tokens).otherwise(0.0)
    return F.when(bare > 0, F.round(score, 4)).otherwise(0.0)
