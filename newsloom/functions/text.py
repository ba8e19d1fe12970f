"""Text functions: folds, hashes, sentences, chunks, n-grams, similarity, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.config import DEFAULT, EngineConfig

TR_FROM, TR_TO = "çğıİöşüÇĞÖŞÜ", "cgiIosuCGOSU"
#: Paragraphs that are no text of the article.
BOILERPLATE = (
    r"abone\s*ol(un)?", r"haberi\s*kaydet", r"son\s*dakika\s*haberleri", r"reklam(?!\s*\w)", r"sponsor(lu)?\s*içerik", r"yorum(lar)?\s*yap",
    r"yorum(unu(zu)?)?\s*ekle", r"diğer\s*haberler", r"i?lgili\s*haberler", r"bu\s*haberi\s*paylaş", r"sosyal\s*medyada\s*paylaş",
    r"fotoğraf:\s*[^\n]{0,80}$", r"foto:\s*[^\n]{0,80}$", r"©\s*\d{4}", r"tüm\s*hakları\s*saklıdır", r"telif\s*hakk[ıi]",
    r"e[-\s]*posta\s*bültenimize\s*kaydolun", r"bültenimize\s*abone", r"whatsapp(?:'tan|'da)?\s*takip\s*et", r"instagram(?:'da|'dan)?\s*takip\s*et",
    r"şu\s*haberler\s*da\s*ilginizi\s*çekebilir", r"editör(ün)?\s*notu",
)
BOILERPLATE_RE = "(?iU)" + "|".join(f"(?:{p})" for p in BOILERPLATE)
SHORT_PARAGRAPH = 80
#: Common words of the languages that occur, for the default language test.
STOP_WORDS = {
    "tr": ("ve", "bir", "bu", "için", "ile", "da", "de", "olarak"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das"),
    "fr": ("le", "la", "de", "les", "des", "et", "en", "un"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "un"),
}
DIGIT_NOISE = r"[\s\d\W_]*"


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space as single spaces, and none at the ends; single spaces are left where they are."""
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[\s&&[^ ]]", " "))


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def content_hash(text: Column) -> Column:
    return F.sha2(squeeze(F.lower(text)), 256)


#: Fixed value: what a title is stripped of at both ends.
TITLE_EDGE = " .,;:!?-\"'"


def normalize_title(title: Column) -> Column:
    """Lower case, single spaces, and no punctuation at either end; punctuation within stays."""
    return F.trim(squeeze(F.lower(F.coalesce(title, F.lit("")))), F.lit(TITLE_EDGE))


def title_hash(title: Column) -> Column:
    return F.sha2(normalize_title(title), 256)


def estimate_tokens(text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.floor(F.size(words(text)) * F.lit(cfg.token_coefficient)).cast("int")


def remove_boilerplate(text: Column, sep: str = "\n\n") -> Column:
    """A struct of the text left and the share of paragraphs removed. Short paragraphs that hold a pattern go; a text without
    any paragraph comes back as it is."""
    paragraphs = F.filter(F.transform(F.split(text, sep), strip), lambda p: p != "")

    def sifted(ps: Column) -> Column:
        kept = F.filter(ps, lambda p: ~((F.length(p) < SHORT_PARAGRAPH) & F.rlike(p, F.lit(BOILERPLATE_RE))))
        return let(kept, lambda k: F.struct(F.when(F.size(ps) > 0, F.array_join(k, sep)).otherwise(text).alias("text"), F.coalesce(F.round(1 - F.try_divide(F.size(k), F.size(ps)), 3), F.lit(0.0)).alias("removed")))

    return let(paragraphs, sifted)


def language(text: Column, least: int = 50) -> Column:
    """A struct of code and confidence by common words; short texts count as Turkish with confidence 0. A text's words are cut once
    for all languages."""
    every = sorted({x for s in STOP_WORDS.values() for x in s})
    common = F.filter(words(F.lower(F.substring(text, 1, 5000))), lambda x: x.isin(*every))
    hits = lambda w: F.array(*(F.struct(F.size(F.filter(w, lambda x: x.isin(*s))).alias("n"), F.lit(c).alias("code")) for c, s in STOP_WORDS.items()))

    def told(h: Column) -> Column:
        return let(F.struct(F.array_max(h).alias("best"), F.aggregate(h, F.lit(0), lambda a, x: a + x["n"]).alias("total")), lambda t: F.struct(
            F.when(t["total"] > 0, t["best"]["code"]).otherwise("tr").alias("code"), F.coalesce(F.try_divide(t["best"]["n"], t["total"]), F.lit(0.0)).alias("confidence")
        ))

    return F.when(F.length(F.coalesce(text, F.lit(""))) < least, F.struct(F.lit("tr").alias("code"), F.lit(0.0).alias("confidence"))).otherwise(let(let(common, hits), told))


def quality(length: Column, removed: Column, has_date: Column, confidence: Column) -> Column:
    one = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.least(F.lit(1.0), 1 - F.least(removed * 2, F.lit(0.5)) + one(length >= 500, 0.1) + one(has_date, 0.05) + one(confidence >= 0.95, 0.05))


def sentences(text: Column, shortest: int = 3) -> Column:
    """Cut after closing punctuation before a capital or a quote; a sentence under three characters joins the
    one before it."""
    parts = F.split(F.trim(text), r"(?<=[.!?…])\s+(?=[A-ZÇĞİıÖŞÜ\"'“‘])")
    joined = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, s: F.when(
            (F.length(s) < shortest) & (F.size(a) > 0),
            F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(a, F.lit(-1)), F.lit(" "), s))),
        ).otherwise(F.concat(a, F.array(s))),
    )
    return F.filter(joined, lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """What empty lines part, without white space at the ends."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n{2,}"), strip), lambda p: p != "")


def title_prefix(title: Column | None, subtitle: Column | None) -> Column:
    """What stands before every chunk of an article; empty without titles."""
    head = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{mark}: "), strip(c), F.lit("\n\n"))).otherwise("")
    parts = [head(mark, c) for mark, c in (("BAŞLIK", title), ("ALT BAŞLIK", subtitle)) if c is not None]
    return F.concat(*parts) if parts else F.lit("")


def ascii_fold(text: Column) -> Column:
    return F.translate(text, TR_FROM, TR_TO)


def kebab(text: Column) -> Column:
    """Folded before lower-casing; everything else between hyphens."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(text)), r"[^a-z0-9]+", "-"), F.lit("-"))


def slug(text: Column, most: int = 140) -> Column:
    return F.trim(F.substring(kebab(text), 1, most), F.lit("-"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded by two spaces before and one after."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    grams = F.transform(w, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.substring(F.concat(F.lit("  "), x, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """Runs of low to high tokens joined by spaces, distinct, shorter ones first."""
    of = lambda n: F.when(
        F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(n) for n in range(low, high + 1))))


def phrase_threshold(n_chars: Column) -> Column:
    """The least trigram similarity by the length of a query."""
    return F.when(n_chars <= 3, 0.05).when(n_chars <= 6, 0.10).otherwise(0.15)


#: What stands for quotation marks in queries.
QUOTES = "'‘’‚‛′ʼʹ\"“”„‟″«»‹›`"


def normalize_query(text: Column) -> Column:
    return squeeze(F.translate(F.lower(F.coalesce(text, F.lit(""))), QUOTES, ""))


#: Percentages, fractions, money, counts with units, scores, ordinals, years of the old reckoning.
NUMERIC = (
    r"(?:yüzde\s+\d+(?:[,\.]\d+)?|%\s*\d+(?:[,\.]\d+)?|\d+(?:[,\.]\d+)?\s*%)",
    r"\b\d+/\d+\b",
    r"\d+(?:[,\.]\d+)?\s*(?:milyon|milyar|bin)?\s*(?:tl|dolar|avro|euro|drahmi|usd|tlrl|sterlin|yen|yuan)",
    r"\b\d+(?:[,\.]\d+)?\s*(?:[a-zçğıöşü]+\s+)?(?:ülke|kent|şehir|ilçe|kişi|asker|metre|km|kilometre|hektar|fide|fidan|gün|saat|dakika|hafta|ay|yıl|sn|saniye|skor|puan|gol|sayı|gönderi|tweet|paylaşım|maç)\b",
    r"\b\d{1,3}-\d{1,3}\b",
    r"\b\d+\.\s*(?:hafta|gün|ay|yıl|yarı|tur|sezon|dakika)\b",
    r"\b(?:MÖ|MS)\s*\d{1,4}\b",
)
#: Which of them tell capitals apart.
CASED = (1, 4, 6)


def numeric_spans(text: Column, each: int = 5) -> Column:
    """The first few spans of each pattern as they are written, of 2 to 60 characters; of those that differ in capitals and
    spaces only, the first."""
    flags = ("(?U)" if i in CASED else "(?iU)" for i in range(len(NUMERIC)))
    found = F.flatten(F.array(*(F.slice(F.regexp_extract_all(text, F.lit(f"{f}({p})"), F.lit(1)), 1, each) for f, p in zip(flags, NUMERIC, strict=True))))
    spans = F.filter(F.transform(found, strip), lambda s: F.length(s).between(2, 60))
    keyed = F.transform(spans, lambda s: F.struct(squeeze(F.lower(s)).alias("k"), s.alias("s")))
    once = let(keyed, lambda a: F.filter(a, lambda x, i: F.array_position(F.transform(a, lambda y: y["k"]), x["k"]) == i + 1))
    return F.transform(once, lambda x: x["s"])


def normalized_levenshtein(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


#: Spoiled forms of the citation mark ``[#n]``, each in the brackets in which it occurs.
CITATIONS = (("ID", "[]"), ("ID", "()"), ("ref", "[]"), ("ref", "()"), ("kaynak", "[]"), ("kaynak", "()"), ("source", "[]"))


def repair_citations(text: Column) -> Column:
    for word, (left, right) in CITATIONS:
        text = F.regexp_replace(text, rf"(?iU)\{left}\s*{word}\s*[:.\-]?\s*(\d+)\s*\{right}", "[#$1]")
    return text


#: What a full stop may follow without ending a sentence, and the letters that count.
ABBREVIATIONS = ("vb", "vs", "Dr", "Prof", "TC", "ABD", "AB", "TBMM")
LETTERS, CAPITALS = "A-Za-zÇĞİÖŞÜçğıöşü", "A-ZÇĞİÖŞÜ"


def citation_sentences(text: Column) -> Column:
    """Sentences for checking citations: cut before capitals, but not where the last word is an abbreviation."""
    cut = F.regexp_replace(strip(text), rf"(?U)([.!?])\s+(?=[{CAPITALS}])", "$1\u0001")
    joined = F.regexp_replace(cut, rf"(?<![{LETTERS}])((?:{'|'.join(ABBREVIATIONS)})[^{LETTERS}\s\x01]*)\x01", "$1 ")
    return F.filter(F.split(joined, "\u0001"), lambda s: s != "")


def citation_ids(text: Column) -> Column:
    """A number past the integers cites nothing."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[#(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))


def cited_numbers(text: Column, widest: int = 100) -> Column:
    """Numbers in brackets: lists and ranges. A range that is too wide, runs backwards or ends past the integers is its first number; a
    number past the integers cites nothing."""
    inside = F.regexp_extract_all(text, F.lit(r"\[#?W?(\d+(?:\s*[-,]\s*#?W?\d+)*)\]"), F.lit(1))
    parts = F.flatten(F.transform(inside, lambda s: F.split(F.regexp_replace(s, "[#W\\s]", ""), ",")))

    def spread(p: Column) -> Column:
        a, b = F.substring_index(p, "-", 1).try_cast("int"), F.substring_index(p, "-", -1).try_cast("int")
        return F.when((b >= a) & (b - a < widest), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, spread)), lambda x: x.isNotNull())))


def chunk(text: Column, cfg: EngineConfig = DEFAULT, title: Column | None = None, subtitle: Column | None = None) -> Column:
    """Windows over the sentences of all paragraphs: array of (chunk_index, chunk_text, token_count). A window closes when the next sentence
    would pass the target and it has the least size, or would pass the hard limit; a sentence over the limit
    stands alone; a short last window joins the one before it. Each chunk starts with the last words of the
    one before, as many as the overlap allows, after the titles."""
    row = "struct<sents:array<string>,n:int>"
    state = f"struct<done:array<{row}>,cur:array<string>,n:int>"
    none = F.array().cast("array<string>")
    make = lambda done, cur, n: F.struct(done.alias("done"), cur.alias("cur"), n.cast("int").alias("n"))
    window = lambda s, n: F.array(F.struct(s.alias("sents"), n.cast("int").alias("n")))
    flushed = lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], window(a["cur"], a["n"]))).otherwise(a["done"])

    def step(a: Column, s: Column) -> Column:
        n = estimate_tokens(s, cfg)
        full = ((a["n"] + n > cfg.target_tokens) & (a["n"] >= cfg.min_tokens)) | (a["n"] + n > cfg.max_tokens)
        return (
            F.when(n > cfg.max_tokens, make(F.concat(flushed(a), window(F.array(s), n)), none, F.lit(0)))
            .when(full, make(flushed(a), F.array(s), n))
            .otherwise(make(a["done"], F.concat(a["cur"], F.array(s)), a["n"] + n))
        )

    def end(a: Column) -> Column:
        last = F.try_element_at(a["done"], F.lit(-1))
        joined = F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), window(F.concat(last["sents"], a["cur"]), last["n"] + a["n"]))
        return F.when(F.size(a["cur"]) == 0, a["done"]).when((a["n"] < cfg.min_tokens) & (F.size(a["done"]) > 0), joined).otherwise(flushed(a))

    start = F.struct(F.array().cast(f"array<{row}>").alias("done"), none.alias("cur"), F.lit(0).alias("n")).cast(state)
    bodies = F.transform(F.aggregate(F.flatten(F.transform(paragraphs(text), sentences)), start, step, end), lambda w: F.array_join(w["sents"], " "))
    keep = int(cfg.overlap_tokens / cfg.token_coefficient)

    def with_overlap(i: Column, all_: Column) -> Column:
        body = F.element_at(all_, i)
        tail = let(words(F.try_element_at(all_, i - 1)), lambda w: F.slice(w, F.greatest(F.size(w) - (keep - 1), F.lit(1)), F.lit(keep)))
        whole = strip(F.concat(title_prefix(title, subtitle), F.when(i == 1, body).otherwise(F.concat(F.array_join(tail, " "), F.lit(" "), body))))
        return let(whole, lambda w: F.struct((i - 1).alias("chunk_index"), w.alias("chunk_text"), estimate_tokens(w, cfg).alias("token_count")))

    # the windows are bound once: each chunk looks at its own and the one before it
    empty = F.array().cast("array<struct<chunk_index:int,chunk_text:string,token_count:int>>")
    return let(bodies, lambda b: F.when(F.size(b) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), lambda i: with_overlap(i, b))).otherwise(empty))
