"""Functions over search queries: markers, candidates, phrases, standalone test, decomposition, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import TR_FROM, TR_TO, ngrams, squeeze, words

#: What marks a question.
QUESTION_MARKERS = ("?", "kim", "nedir", "neyi", "neyin", "ne zaman", "nerede", "nasıl", "neden", "kaç", "hangi", "var mı", "ne dedi", "söyledi", "yaptı", "ediyor", "olacak", "kimdi", "kaçıncı")
#: What keeps a short query from skipping the planner.
PLANNER_MARKERS = ("?", " ne ", " kim ", " nedir", " neden", " nasıl", " nerede", " kaç ", " hangi", " nezaman", " ne zaman")
#: Words that refer to something said before, and what makes them self-sufficient.
REFERENTIAL = (
    "bu", "şu", "o", "bunu", "şunu", "onu", "bunları", "şunları", "onları", "bunun", "şunun", "onun", "buna", "şuna", "ona", "bundan", "şundan", "ondan",
    "bunlar", "şunlar", "onlar", "böyle", "şöyle", "öyle", "bahsettiğin", "dediğin", "söylediğin", "sözünü", "aynı",
)
DEMONSTRATIVE = ("bu", "şu", "o")
TEMPORAL = ("hafta", "yıl", "sene", "ay", "gün", "sabah", "akşam", "gece", "öğle", "yaz", "kış", "sezon", "dönem", "sefer", "kez", "defa")
FOLLOW_UP = ("başka", "peki", "ayrıca", "hani")
#: Words that are never an entity, folded.
NOISE = ("var", "yok", "olur", "oldu", "olmus", "olacak", "bugun", "dun", "yarin", "zaman", "simdi", "bilgi", "durum", "sey", "konu", "haber", "aciklama", "sonuc")
#: Words that alone say nothing in a phrase.
FILLERS = ("mi", "mı", "mu", "mü", "ve", "ile", "da", "de", "ne", "bir", "bu", "şu", "o", "için", "olacak", "oldu", "kim", "nasıl", "neden", "nedir")
#: Generic terms of sport, awards and news, and endings they may bear.
GENERIC = (
    "maç", "müsabaka", "karşılaşma", "derbi", "lig", "kupa", "turnuva", "final", "gol", "set", "puan", "skor", "galibiyet", "mağlubiyet", "beraberlik", "şampiyon",
    "şampiyonluk", "mvp", "ödül", "oyuncu", "futbolcu", "basketbolcu", "voleybolcu", "sporcu", "kaptan", "antrenör", "hakem", "haber", "gündem", "açıklama", "gelişme",
    "durum", "olay", "konu", "çalışma", "rapor", "analiz", "yorum",
)
ENDINGS = (
    "ler", "lar", "leri", "ları", "lerin", "ların", "lerini", "larını", "lere", "lara", "lerde", "larda", "lerden", "lardan", "nin", "nın", "nun", "nün",
    "in", "ın", "un", "ün", "im", "ım", "um", "üm", "imiz", "ımız", "umuz", "ümüz", "e", "a", "ye", "ya", "i", "ı", "u", "ü", "yi", "yı", "yu", "yü",
    "de", "da", "te", "ta", "den", "dan", "ten", "tan", "deki", "daki", "teki", "taki", "le", "la", "yle", "yla", "ile", "li", "lı", "lu", "lü",
    "siz", "sız", "suz", "süz", "lik", "lık", "luk", "lük", "ci", "cı", "cu", "cü", "çi", "çı", "çu", "çü", "si", "sı", "su", "sü", "ni", "nı", "nu", "nü",
    "na", "ne", "nde", "nda", "nden", "ndan", "se", "sa", "ce", "ca", "çe", "ça",
)

#: Endings that a name sheds. Single vowels stay, since names end in them.
STEM_ENDINGS = (
    "ler", "lar", "leri", "ları", "lerin", "ların", "lerini", "larını", "lere", "lara", "lerde", "larda", "lerden", "lardan", "den", "dan", "ten", "tan",
    "de", "da", "te", "ta", "deki", "daki", "teki", "taki", "nde", "nda", "nden", "ndan", "le", "la", "yle", "yla", "ile", "nin", "nın", "nun", "nün",
    "siz", "sız", "suz", "süz", "lik", "lık", "luk", "lük", "imiz", "ımız", "umuz", "ümüz",
)


def safe_lower(text: Column) -> Column:
    """Lower case with the dotted capital I as a plain i."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def is_question(text: Column) -> Column:
    low = F.trim(F.lower(text))
    return F.exists(F.array(*map(F.lit, QUESTION_MARKERS)), lambda m: F.contains(low, m))


def is_generic_token(token: Column) -> Column:
    return F.rlike(token, F.lit(f"^(?:{'|'.join(GENERIC)})(?:{'|'.join(ENDINGS)})?$"))


def is_generic(name: Column) -> Column:
    """All its tokens are generic terms."""
    w = words(name)
    return (F.size(w) > 0) & F.forall(w, is_generic_token)


def query_words(text: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\u0307", "")
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def canonical_entity(entity: Column, said: Column) -> Column:
    """An entity as its words stand in a query (``said``: the query's words): each must be a word of the query, or a stem of three
    letters and more that a word there bears with an ending; the last sheds its own ending. Null if a word is
    found in neither way, or there is none."""
    ended = F.lit(f"^(?:{'|'.join(ENDINGS)})$")
    tokens = words(entity)

    def grounded(t: Column, i: Column) -> Column:
        stem = F.regexp_replace(t, f"^(.{{3,}}?)(?:{'|'.join(STEM_ENDINGS)})$", "$1")
        borne = (F.length(t) >= 3) & F.exists(said, lambda w: F.startswith(w, t) & F.rlike(F.substr(w, F.length(t) + 1), ended))
        return F.when(F.array_contains(said, t), F.when(i == F.size(tokens) - 1, stem).otherwise(t)).when(borne, t)

    found = F.transform(tokens, grounded)
    return F.when((F.size(tokens) > 0) & F.forall(found, lambda x: x.isNotNull()), F.array_join(found, " "))


def planner_bypass(text: Column) -> Column:
    """For a query of one to four words that is no question: its two longest words of 3 to 30 characters that are not
    generic; null for other queries."""
    w = words(F.trim(text))
    padded = F.concat(F.lit(" "), F.lower(F.trim(text)), F.lit(" "))
    asks = F.exists(F.array(*map(F.lit, PLANNER_MARKERS)), lambda m: F.contains(padded, m))
    low = F.transform(w, lambda x: F.trim(F.lower(x), F.lit(".,!?:;\"'")))
    good = F.filter(low, lambda x: F.length(x).between(3, 30) & ~is_generic_token(x))
    ranked = F.array_sort(F.transform(good, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("w"))))
    return F.when(F.size(w).between(1, 4) & ~asks, F.transform(F.slice(ranked, 1, 2), lambda r: r["w"]))


def entity_candidates(text: Column, least: int = 5, stop: tuple[str, ...] = FILLERS) -> Column:
    """Distinct tokens of some length that are no stop words; apostrophes part a word from its ending."""
    spaced = F.translate(safe_lower(text), "'’‘`´", "     ")
    tokens = F.regexp_extract_all(spaced, F.lit(r"([\p{L}0-9][\p{L}0-9-]*)"), F.lit(1))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin(*stop)))


def phrases(text: Column, low: int = 2, high: int = 4) -> Column:
    """Runs of two to four words with at least one that says something, of five characters or more."""
    return F.filter(ngrams(words(text), low, high), lambda p: (F.length(p) >= 5) & ~F.forall(F.split(p, " "), lambda w: w.isin(*FILLERS)))


def is_noise(name: Column) -> Column:
    folded = F.regexp_replace(F.translate(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "̇", ""), TR_FROM + "âîû", TR_TO + "aiu"), "[^a-z0-9]", "")
    return folded.isin(*NOISE)


def has_dangling_referent(tokens: Column) -> Column:
    """A word that needs what was said before. This, that and it don't if a time word follows."""
    at = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.coalesce(F.try_element_at(tokens, i + 2), F.lit("")).alias("next")))
    return F.exists(at, lambda x: x["t"].isin(*FOLLOW_UP) | (x["t"].isin(*REFERENTIAL) & ~(x["t"].isin(*DEMONSTRATIVE) & x["next"].isin(*TEMPORAL))))


def has_proper_noun(text: Column) -> Column:
    """An apostrophe within a word, a number of two digits, or a capital that doesn't start the text."""
    later = F.slice(words(text), F.lit(2), F.greatest(F.size(words(text)), F.lit(1)))
    return F.rlike(text, F.lit(r"(?U)[^\W\d_]+['’][^\W\d_]+")) | F.rlike(text, F.lit(r"\b\d{2,}\b")) | F.exists(later, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))


def is_standalone(text: Column) -> Column:
    """Dangling words first, then proper nouns, then length."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.when(F.size(tokens) == 0, False).when(has_dangling_referent(tokens), False).when(has_proper_noun(text), True).otherwise(F.size(tokens) > 3)


def decompose(text: Column, most: int = 4) -> Column:
    """Parts of a query joined by *ve*, *ayrıca*, *hem* or *bir de*: each of two words and six characters at least, distinct,
    none the whole query; none at all unless there are two."""
    parts = F.split(F.trim(text), r"(?iU)\s*,?\s+(?:ve|ayrıca|hem|bir de)\s+")
    clean = F.transform(parts, lambda p: F.regexp_replace(F.trim(F.trim(p), F.lit('"')), r"(?iU)\s+(?:nedir|nasıl|neler|hakkında|ne oldu)\s*\??$", ""))
    good = F.filter(clean, lambda p: (F.length(p) >= 6) & (F.size(words(p)) >= 2) & (squeeze(F.lower(p)) != squeeze(F.lower(text))))
    keyed = F.transform(good, lambda p: F.struct(squeeze(F.lower(p)).alias("k"), p.alias("p")))
    keys = F.array_distinct(F.transform(keyed, lambda s: s["k"]))
    once = F.slice(F.transform(keys, lambda k: F.filter(keyed, lambda s: s["k"] == k)[0]["p"]), 1, most)
    return F.when(F.size(once) >= 2, once).otherwise(F.array().cast("array<string>"))


def since_hours(oldest: Column, now: Column, default: int, least: int = 6) -> Column:
    """Hours back to the oldest time asked for, rounded up, within bounds; the default without one."""
    hours = F.ceil((F.unix_seconds(now) - F.unix_seconds(oldest)) / 3600.0)
    return F.when(oldest.isNull() | now.isNull(), default).otherwise(F.greatest(F.lit(least), F.least(F.lit(default), hours))).cast("int")


def title_tier(title: Column, query: Column) -> Column:
    """0 for the exact title, 2 for lists and disambiguations, else 1."""
    t, q = (squeeze(safe_lower(c)) for c in (title, query))
    side = F.rlike(t, F.lit(r"(listesi|anlam ayrımı|karakterleri|bölümleri)$")) | F.rlike(t, F.lit(r"\([^)]+\)$"))
    return F.when(t == q, 0).when(side, 2).otherwise(1)


def event_edition(title: Column) -> Column:
    """A struct of an event's name and its edition: a leading year or ordinal, if two words are left."""
    t = F.trim(title)
    found = F.regexp_extract(t, r"^(\d{4}|\d+\.)\s+\S", 1)
    base = F.trim(F.substring(t, F.length(found) + 1, F.length(t)))
    ok = (found != "") & (F.length(base) >= 3) & (F.size(words(base)) >= 2)
    return F.struct(F.when(ok, base).otherwise(t).alias("base"), F.when(ok, found).alias("edition"))


def type_fits(kind: Column, classes: Column, human: str = "Q5", dates: tuple[str, ...] = ("Q47018901", "Q14795564", "Q573")) -> Column:
    """A person must be a human; anything else must be neither a human nor a date."""
    c = F.coalesce(classes, F.array().cast("array<string>"))
    is_human = F.array_contains(c, human)
    return F.when(kind == "person", is_human).otherwise(~is_human & ~F.arrays_overlap(c, F.array(*map(F.lit, dates))))


def cache_key(*parts: Column) -> Column:
    """SHA-1 of normalised parameters; arrays are sorted first by the caller."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(squeeze(F.lower(p.cast("string"))), F.lit("")) for p in parts)))
