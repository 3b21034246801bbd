"""Text and address normalisation as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: abbreviations of French street and place names
ABBREVIATIONS = {
    "st": "saint", "ste": "sainte", "sts": "saints", "stes": "saintes", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard",
    "bvd": "boulevard", "boul": "boulevard", "che": "chemin", "chem": "chemin", "rte": "route", "pl": "place", "imp": "impasse", "all": "allee",
    "res": "residence", "resid": "residence", "fbg": "faubourg", "sq": "square", "crs": "cours", "prom": "promenade", "esp": "esplanade",
    "gd": "grand", "gde": "grande", "mt": "mont", "nd": "notre dame", "ctre": "centre", "za": "zone artisanale", "zi": "zone industrielle",
    "zac": "zone activite", "ld": "lieu dit", "rpt": "rond point", "hlm": "hlm",
}
# fixed values: words without meaning of their own
STOP_WORDS = ("de", "du", "des", "la", "le", "les", "l", "d", "a", "au", "aux", "et", "en", "sur", "sous", "un", "une", "the", "of", "in", "near", "at", "and", "on")
# fixed values: legal forms and articles that name similarity passes over
GENERIC_WORDS = ("sarl", "sas", "sasu", "eurl", "sa", "sci", "snc", "et", "de", "du", "des", "la", "le", "les", "l", "d", "a", "au", "aux", "en")
# fixed values: road number prefixes
ROAD_PREFIXES = ("n", "d", "a", "rn", "rd", "c", "vc", "cr", "e")

# fixed values: what may follow a house number
HOUSE_SUFFIXES = ("bis", "ter", "quater", "quinquies", "a", "b", "c", "d", "e", "f")
JOINED_SUFFIX = "bis|ter|quater|[a-f]"
# fixed values: patterns of labels
CUT_PARENTHESIS, LOOSE_ENDS = r"\s*\([^)]*$", r"^[\s\-–—,;:/_]+|[\s\-–—,;:/_]+$"
ROAD_NUMBER = "[0-9]{1,4}[a-z]?"


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with a mark, and their bases."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xE0, 0x180) if chr(c).islower()]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _accents()


def normalize_text(c: Column) -> Column:
    """Lower case without accents or ligatures, straight apostrophes, single spaces."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "œ", "oe"), "æ", "ae")
    c = F.translate(c, _MARKED + "’`", _PLAIN + "''")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold_text(c: Column) -> Column:
    """normalize_text with every run of other characters than letters, digits and & as one space."""
    return F.trim(F.regexp_replace(normalize_text(c), "[^a-z0-9&]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(fold_text(c), " "), lambda w: w != "")


def search_tokens(c: Column) -> Column:
    """Tokens with road numbers joined, abbreviations spelled out, and stop words left out unless all are."""
    joined = F.regexp_replace(F.concat(F.lit(" "), fold_text(c), F.lit(" ")), rf"(?<= )({'|'.join(ROAD_PREFIXES)}) (?={ROAD_NUMBER} )", "$1")
    short = F.regexp_replace(joined, rf"(?<= )r([nd])(?={ROAD_NUMBER} )", "$1")
    words = F.filter(F.split(short, " "), lambda w: w != "")
    names = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    spelled = F.flatten(F.transform(words, lambda w: F.split(F.coalesce(names[w], w), " ")))
    meant = F.filter(spelled, lambda w: ~w.isin(*STOP_WORDS))
    return F.when(F.size(meant) > 0, meant).otherwise(spelled)


def house_number(c: Column) -> Column:
    """12b, 12 B and 12 b alike."""
    return F.array_join(tokens(F.regexp_replace(c, "(?i)^([0-9]+)([a-z]+)$", "$1 $2")), " ")


def parsed_query(c: Column) -> Column:
    """struct<words, number, rest, tokens> of a query: its folded words, the house number that it begins with or null, the words after that
    number as one string, and the search tokens of these."""

    def split(words: Column) -> Column:
        second, n = F.get(words, F.lit(1)), F.size(words)
        begins = F.get(words, F.lit(0)).rlike("^[0-9]{1,4}$") & (n > 1)
        used = F.when(begins & (n > 2) & second.isin(*HOUSE_SUFFIXES), 2).when(begins & ~second.rlike("^[0-9]"), 1).otherwise(0)
        part = lambda first, size: F.array_join(F.slice(words, first, size), " ")
        return F.struct(words.alias("words"), F.when(used > 0, part(F.lit(1), used)).alias("number"), part(used + 1, n).alias("rest"))

    words = tokens(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)^\s*([0-9]{{1,4}})({JOINED_SUFFIX})\b", "$1 $2"))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return once(once(words, split), lambda p: F.struct(p["words"], p["number"], p["rest"], search_tokens(p["rest"]).alias("tokens")))


def token_variants(t: Column) -> Column:
    """Singular and plural forms of a token, itself left out."""
    last = F.right(t, F.lit(1)).isin("s", "x")
    stem = lambda n, end: F.concat(F.substring(t, F.lit(1), F.length(t) - n), F.lit(end))
    forms = F.array(
        F.when((F.length(t) > 3) & last, stem(1, "")),
        F.when((F.length(t) > 4) & t.endswith("aux"), stem(3, "al")),
        F.when((F.length(t) > 2) & ~last & ~t.rlike("^[0-9]"), F.concat(t, F.lit("s"))),
    )
    return F.array_distinct(F.filter(F.array_compact(forms), lambda v: v != t))


def bounded_edits(a: Column, b: Column, most: int) -> Column:
    """Edit distance up to most, most + 1 beyond."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, F.lit(most + 1)).otherwise(d)


def allowed_edits(length: Column) -> Column:
    return F.when(length < 4, 0).when(length < 7, 1).otherwise(2)


def tidy_label(c: Column) -> Column:
    """Without a parenthesis cut off midway and without separators at the ends."""
    cut = F.regexp_replace(c, CUT_PARENTHESIS, "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(cut, LOOSE_ENDS, ""), r"\s+", " "))
    return F.when(bare == "", F.trim(c)).otherwise(bare)


def name_quality(c: Column) -> Column:
    """Accents 2, mixed case 1, hyphen or apostrophe 1, no lower case -2."""
    has = lambda p: c.rlike(p).cast("int")
    return has("[à-ÿÀ-Þ]") * 2 + (c.rlike("[a-z]") & c.rlike("[A-Z]")).cast("int") + has("[-'’]") - (~c.rlike("[a-z]")).cast("int") * 2


def name_tokens(c: Column) -> Column:
    return F.filter(tokens(c), lambda w: ~w.isin(*GENERIC_WORDS))


def similarity(a: Column, b: Column) -> Column:
    """Share of the shorter token list (the first, of equal ones) found in the longer; 0 if either is empty."""
    share = lambda x, y: F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.size(x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(F.size(a) <= F.size(b), share(a, b)).otherwise(share(b, a))


def address_evidence(a: Column, b: Column) -> Column:
    """Whether two folded addresses agree: equal, one inside the other, or a shared word of three letters."""
    long = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 2)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a) | F.arrays_overlap(long(a), long(b)))


def postcode(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b([0-9]{5})\b", 1), F.lit(""))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII string."""
    prime = F.lit(16777619).cast("long")
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * prime).bitwiseAND(F.lit(4294967295).cast("long")))


# fixed values: words that stay in lower case inside a name
PARTICLES = ("de", "du", "des", "la", "le", "les", "et", "sur", "en", "aux", "au", "sous", "à", "a", "d", "l", "lès")


def display_case(c: Column) -> Column:
    """Title case for names that come in one case; mixed case is trusted. Parts after a hyphen or apostrophe
    are capitalised too, particles and elisions stay lower."""
    bare = F.trim(F.regexp_replace(c, r"\s+", " "))
    lower, upper = bare.rlike("[a-zß-ÿ]"), bare.rlike("[A-ZÀ-Þ]")

    def title(word: Column) -> Column:
        parts = F.regexp_extract_all(word, F.lit("[-'’]?[^-'’]*"), F.lit(0))
        raised = F.transform(parts, lambda p: F.when(p.rlike("^[-'’]"), F.concat(F.substring(p, 1, 1), F.upper(F.substring(p, 2, 1)), F.substring(p, F.lit(3), F.length(p)))).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))))
        return F.array_join(raised, "")

    def placed(word: Column, i: Column) -> Column:
        elided = F.when(word.rlike("^[ld]['’]"), F.concat(F.substring(word, 1, 1), F.substring(title(word), F.lit(2), F.length(word)))).otherwise(title(word))
        return F.when(i == 0, title(word)).when(word.isin(*PARTICLES), word).otherwise(elided)

    return F.when(lower & upper | ~lower & ~upper, bare).otherwise(F.array_join(F.transform(F.split(F.lower(bare), " "), placed), " "))


def postal_address(c: Column) -> Column:
    """struct<number, street, postcode, city> of a one-line address; what is missing is null."""
    part = lambda k: F.nullif(F.trim(F.regexp_extract(F.trim(c), r"(?i)^\s*(?:([0-9]{1,4}(?:\s*(?:bis|ter|quater|[a-d])(?=\s))?)[,\s]+)?(.*?)[,\s]*(?:\b([0-9]{5})\b\s*(.*))?$", k)), F.lit(""))
    return F.struct(F.lower(part(1)).alias("number"), part(2).alias("street"), part(3).alias("postcode"), part(4).alias("city"))
