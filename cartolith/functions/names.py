"""Names as they are shown, and the keys that names are matched by, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# fixed values: street types and what they are spelled out as
STREET_TYPES = {
    "r": "Rue", "rue": "Rue", "av": "Avenue", "ave": "Avenue", "bd": "Boulevard", "bld": "Boulevard", "che": "Chemin", "chem": "Chemin", "ch": "Chemin", "rte": "Route",
    "pl": "Place", "imp": "Impasse", "all": "Allée", "sq": "Square", "prom": "Promenade", "rpt": "Rond-Point", "res": "Résidence", "lot": "Lotissement", "crs": "Cours",
    "fg": "Faubourg", "fbg": "Faubourg", "qu": "Quai", "pkg": "Parking", "ham": "Hameau", "sen": "Sentier", "rle": "Ruelle", "rlle": "Ruelle", "tra": "Traverse",
    "pass": "Passage", "esp": "Esplanade", "cr": "Chemin rural", "vc": "Voie communale",
}
# fixed values: words that stay in lower case inside a compound
COMPOUND_PARTICLES = ("de", "du", "des", "d", "la", "le", "les", "l", "sur", "sous", "en", "et", "lès", "lez", "ès", "à", "aux", "au", "dit")
# fixed values: legal forms that a sign does not show
LEGAL_FORMS = (
    "SARL", "SAS", "SASU", "EURL", "SA", "SCI", "SNC", "SCM", "SCP", "SELARL", "SELAS", "SELAFA", "SELURL", "SCEA", "EARL", "GAEC", "GFA", "SCOP", "SEM", "SPL", "EI",
    "EIRL", "SC", "GIE",
)
# fixed values: words that stay in lower case inside a business name
SMALL_WORDS = ("de", "du", "des", "la", "le", "les", "et", "en", "au", "aux", "sur", "sous", "a", "à", "d", "l")
# fixed values: what registers abbreviate at the start of a street
REGISTER_TYPES = {
    "AV": "AVENUE", "AVE": "AVENUE", "BD": "BOULEVARD", "BLD": "BOULEVARD", "BOUL": "BOULEVARD", "PL": "PLACE", "CHE": "CHEMIN", "CHEM": "CHEMIN", "CH": "CHEMIN",
    "RTE": "ROUTE", "IMP": "IMPASSE", "ALL": "ALLEE", "RES": "RESIDENCE", "CRS": "COURS", "FBG": "FAUBOURG", "SQ": "SQUARE", "QU": "QUAI", "PROM": "PROMENADE",
    "HAM": "HAMEAU", "LOT": "LOTISSEMENT", "CTRE": "CENTRE", "RPT": "ROND POINT", "PASS": "PASSAGE", "SENT": "SENTIER", "CHS": "CHAUSSEE", "MTE": "MONTEE", "VLA": "VILLA",
    "DOM": "DOMAINE", "ESP": "ESPLANADE", "R": "RUE", "VC": "VOIE COMMUNALE", "CR": "CHEMIN RURAL", "ZA": "ZONE ARTISANALE", "ZI": "ZONE INDUSTRIELLE", "ST": "SAINT",
    "STE": "SAINTE",
}
# fixed values: articles in front of a place name
LEADING_ARTICLE = r"^(LE|LA|LES|L|AU|AUX|A|EN|DE|DU|DES)\s+"
# fixed values: kinds whose labels sometimes come in capitals
SHOUTED_KINDS = ("poi", "business", "landuse", "building", "transport", "structure")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _raised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def capitalise_compounds(c: Column) -> Column:
    """Sadi-carnot as Sadi-Carnot; particles between hyphens stay lower. Only a part that follows a capitalised one is raised."""
    parts = F.split(c, "-")

    def step(s: Column, part: Column) -> Column:
        head = F.regexp_extract(part, r"^(\p{Ll}+)", 1)
        after = F.coalesce(s["last"].rlike(r"\p{Lu}[\p{Ll}'’]*$"), F.lit(False)) & (head != "") & ~head.isin(*COMPOUND_PARTICLES)
        whole = F.when(after, _raised(part)).otherwise(part)
        # a part raised with its neighbour was read with it and cannot raise the next
        seen = F.when(after & (head == part), F.lit("")).otherwise(whole)
        return F.struct(F.concat(s["out"], F.when(s["last"].isNull(), F.lit("")).otherwise("-"), whole).alias("out"), seen.alias("last"))

    return F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("last")), step, lambda s: s["out"])


def street_name(c: Column) -> Column:
    """A street as on its sign: the type spelled out, compounds capitalised."""
    words = F.split(T.display_case(c), " ")
    first = F.lower(F.regexp_replace(F.get(words, F.lit(0)), r"\.$", ""))
    spelled = F.when(F.size(words) > 1, F.coalesce(_lookup(STREET_TYPES, first), F.get(words, F.lit(0)))).otherwise(F.get(words, F.lit(0)))
    whole = F.concat_ws(" ", spelled, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))))
    return F.when(c.isNotNull(), capitalise_compounds(whole))


def canonical_label(kind: Column, c: Column) -> Column:
    """A label by kind: streets as signposted, places with compounds, shouted labels of other kinds in title case."""
    tidy = T.tidy_label(c)
    shouted = kind.isin(*SHOUTED_KINDS) & ~tidy.rlike("[a-zß-ÿ]") & tidy.rlike("[A-Z]{3}")
    return F.when(kind == "road", street_name(tidy)).when(kind == "place", capitalise_compounds(tidy)).when(shouted, T.display_case(tidy)).otherwise(tidy)


def business_name(c: Column) -> Column:
    """The name on a sign: without legal forms and parentheses, shouted names in title case; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\(.*?\)", " "), r"\([^)]*$", " ")
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"^[\s\-–—,;:/.]+|[\s\-–—,;:/]+$", "")
    words = F.filter(F.split(bare, " "), lambda w: ~F.upper(F.regexp_replace(w, "[.,]", "")).isin(*LEGAL_FORMS))

    def cased(word: Column, i: Column) -> Column:
        low = F.lower(word)
        pieces = F.regexp_extract_all(low, F.lit("[-'’]?[^-'’]*"), F.lit(0))
        title = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[-'’]"), F.concat(F.substring(p, 1, 1), F.upper(F.substring(p, 2, 1)), F.substring(p, F.lit(3), F.length(p)))).otherwise(_raised(p))), "")
        elided = F.when((i > 0) & title.rlike(r"^[DL]'\p{L}"), F.concat(F.lower(F.substring(title, 1, 1)), F.substring(title, F.lit(2), F.length(title)))).otherwise(title)
        return F.when((i > 0) & low.isin(*SMALL_WORDS), low).otherwise(elided)

    out = F.when(bare == F.upper(bare), F.array_join(F.transform(words, cased), " ")).otherwise(F.array_join(words, " "))
    return F.nullif(F.trim(out), F.lit(""))


def _upper_key(c: Column) -> Column:
    """Capital letters and digits in single-spaced words, without accents."""
    plain = F.translate(F.lower(c), T._MARKED, T._PLAIN)
    return F.trim(F.regexp_replace(F.upper(plain), "[^A-Z0-9]+", " "))


def street_key(c: Column) -> Column:
    """Key of a street: accent-free capitals without a leading lieu-dit, the first word and saints spelled out."""
    words = F.split(F.regexp_replace(_upper_key(c), r"^(LD|LIEU DIT)( |$)", ""), " ")
    full = F.transform(words, lambda w, i: F.when((i == 0) | w.isin("ST", "STE"), F.coalesce(_lookup(REGISTER_TYPES, w), w)).otherwise(w))
    return F.array_join(full, " ")


def place_key(c: Column) -> Column:
    """Key of a commune or place: accent-free capitals, saints spelled out."""
    return F.array_join(F.transform(F.split(_upper_key(c), " "), lambda w: F.when(w == "ST", "SAINT").when(w == "STE", "SAINTE").otherwise(w)), " ")


def toponym_keys(c: Column) -> Column:
    """Keys of a place name with and without its leading article."""
    key = F.regexp_replace(place_key(c), r"^(LD|LIEU DIT)\s+", "")
    bare = F.regexp_replace(key, LEADING_ARTICLE, "")
    return F.when((bare != key) & (bare != ""), F.array(key, bare)).otherwise(F.array(key))


def duplicate_key(c: Column) -> Column:
    """Identity of a name among search records: its meaningful tokens, else its folded text."""
    meant = F.filter(T.search_tokens(c), lambda w: ~w.isin(*T.STOP_WORDS))
    return F.when(F.size(meant) > 0, F.array_join(meant, " ")).otherwise(T.fold_text(c))


def match_key(c: Column) -> Column:
    """Key of conflation: lower case, accent-free, letters and digits in single-spaced words; empty for null."""
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), T._MARKED, T._PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def category_text(c: Column) -> Column:
    """Text that category phrases are looked for in: as match_key, with & kept and apostrophes as spaces; no ligatures undone."""
    plain = F.regexp_replace(F.translate(F.lower(c), T._MARKED, T._PLAIN), "[’'`]", " ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9&]+", " "))


def nature_key(c: Column) -> Column:
    """Key of a nature: lower case, accent-free, straight apostrophes, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), T._MARKED, T._PLAIN), "’", "'"), r"\s+", " "))
