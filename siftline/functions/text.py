"""Text expressions. All of them are Column -> Column and, but for ``inverted_index``, stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import vocab

# Patterns of references, links and years.
DOI_RE = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
URL_RE = r"(?i)https?://[^\s)>\]]+"
YEAR_RE = r"\b(?:19|20)\d{2}\b"

SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]"
#: The same as single characters.
SPACE_CHARS = " \t\n\x0b\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\x1c\x1d\x1e\x1f"
LINE_SPACE = r"[ \t\f\x0b\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\u0085\u2028\u2029]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``. An expression that occurs several
    times inside a lambda would otherwise be computed at every occurrence."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed, null becomes ''."""
    # runs that are one blank already are passed over, and printable ASCII is told apart before the long class is tried
    return F.trim(F.regexp_replace(text_or_empty(c), rf" (?![!-~]){SPACE}+|(?![ -~]){SPACE}+", " "))


def normalize(c: Column) -> Column:
    return F.replace(F.lower(text_or_empty(c)), F.lit("ё"), F.lit("е"))


def _drop_words(tokens: Column, words: list[str]) -> Column:
    """The word list goes over as one SQL text; a literal per word would cost one call
    to the JVM each."""
    quoted = ", ".join(f"'{w}'" for w in words)
    return F.call_function("filter", tokens, F.expr(f"t -> t NOT IN ({quoted})"))


def tokenize(c: Column) -> Column:
    """Words of two or more characters without Russian and English stop words."""
    return _drop_words(F.regexp_extract_all(normalize(c), F.lit(vocab.TOKEN_RE), F.lit(0)), vocab.STOPWORDS)


def tokenize_tfidf(c: Column) -> Column:
    """The TF-IDF tokens: only Russian stop words go, and the letter ё is not folded."""
    words = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(vocab.TOKEN_RE), F.lit(0))
    return _drop_words(words, vocab.RU_STOP)


def library_tokens(c: Column) -> Column:
    """Distinct tokens of a library item: three or more characters, not a number. The pattern passes over the others, and
    no token holds white space, so the text need not be collapsed."""
    words = F.regexp_extract_all(normalize(c), F.lit(vocab.LIBRARY_WORD_RE), F.lit(0))
    return _drop_words(F.array_distinct(words), vocab.LIBRARY_STOP)


def detect_lang(c: Column) -> Column:
    """'ru' if Cyrillic letters are at least as many as Latin ones, 'en' if fewer,
    'other' without letters."""
    low = F.lower(text_or_empty(c))
    cyr = F.regexp_count(low, F.lit("[а-я]"))
    lat = F.regexp_count(low, F.lit("[a-z]"))
    return F.when(cyr + lat == 0, "other").when(cyr >= lat, "ru").otherwise("en")


def detect_language(c: Column, first: int | None = None) -> Column:
    """Language of the metadata: null below 40 letters, 'mixed' without a 55 % majority.
    The whole text decides, or its ``first`` characters if the caller wants so."""
    sample = text_or_empty(c) if first is None else F.substring(text_or_empty(c), 1, first)
    cyr = F.regexp_count(sample, F.lit("[А-Яа-яЁё]"))
    lat = F.regexp_count(sample, F.lit("[A-Za-z]"))
    total = cyr + lat
    share = F.nullif(total, F.lit(0)).cast("double")
    return (
        F.when(total < 40, F.lit(None).cast("string"))
        .when(cyr / share > 0.55, "ru")
        .when(lat / share > 0.55, "en")
        .otherwise("mixed")
    )


def clean_text(c: Column) -> Column:
    """Line ends become LF, lines lose trailing blanks, the whole text is stripped."""
    unix = F.regexp_replace(text_or_empty(c), r"\r\n|\r", "\n")
    lines = F.regexp_replace(unix, rf"{LINE_SPACE}+(?=\n|\z)", "")
    return strip(lines)


def cut(c: Column, limit: int, keep: int | None = None, mark: str = "...") -> Column:
    """At most ``limit`` characters as they are, else the first ``keep``, right-stripped, plus ``mark``."""
    keep = limit if keep is None else keep
    head = F.regexp_replace(F.substring(c, 1, keep), rf"{SPACE}+\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(head, F.lit(mark)))


def excerpt(c: Column, limit: int = 240) -> Column:
    return cut(collapse(c), limit, limit - 3)


def trim_at_word(c: Column, limit: int = 220) -> Column:
    """Cut at the last blank unless that loses over 40 % of the limit."""
    def short(text):
        clipped = F.substring(text, 1, limit + 1)
        boundary = F.length(clipped) - F.instr(F.reverse(clipped), " ")
        at_blank = (F.instr(clipped, " ") > 0) & (boundary >= int(limit * 0.6))
        head = F.when(at_blank, F.substring(clipped, F.lit(1), boundary)).otherwise(F.substring(clipped, 1, limit))
        return F.concat(F.regexp_replace(head, r"[ ,;:\-]+\z", ""), F.lit("..."))

    return let(collapse(c), lambda text: F.when(F.length(text) <= limit, text).otherwise(short(text)))


def head_tail(c: Column, limit: Column) -> Column:
    """A long text is shown by its head (60 %) and tail around ' ... '."""
    head_len = F.greatest((limit * F.lit(0.6)).cast("int"), F.lit(120))
    tail_len = F.greatest(limit - head_len - 5, F.lit(80))

    def ends(text):
        head = F.regexp_replace(F.substring(text, F.lit(1), head_len), r"[ ,;:\-]+\z", "")
        tail = F.regexp_replace(F.right(text, tail_len), r"^[ ,;:\-]+", "")
        return F.concat(head, F.lit(" ... "), tail)

    return let(collapse(c), lambda text: F.when(F.length(text) <= limit, text).otherwise(ends(text)))


def strip_tags(c: Column) -> Column:
    return strip(F.regexp_replace(text_or_empty(c), r"<[^>]+>", " "))


def distinct_ignoring_case(items: Column) -> Column:
    """First spelling of every entry, in order."""
    return let(items, lambda all_items: let(
        F.transform(all_items, F.lower),
        lambda low: F.filter(all_items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def references(c: Column, limit: int | None = None) -> Column:
    """DOIs, then links, without trailing punctuation, distinct regardless of case."""
    text = text_or_empty(c)
    found = F.concat(
        F.regexp_extract_all(text, F.lit(DOI_RE), F.lit(0)),
        F.regexp_extract_all(text, F.lit(URL_RE), F.lit(0)),
    )
    keys = F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"[.,;]+\z", ""))
    distinct = distinct_ignoring_case(F.filter(keys, lambda x: x != ""))
    return distinct if limit is None else F.slice(distinct, 1, limit)


def extract_year(*values: Column) -> Column:
    """Year of the first value that shows one."""
    hits = [F.nullif(F.regexp_extract(text_or_empty(v), YEAR_RE, 0), F.lit("")) for v in values]
    return F.coalesce(*hits).cast("int")


def split_names(c: Column) -> Column:
    parts = F.split(text_or_empty(c), r";|,|\band\b")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def split_tokens(c: Column) -> Column:
    parts = F.split(text_or_empty(c), r"[,;\n]")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def author_line(names: Column, shown: int = 4) -> Column:
    """The first four names, with ' et al.' if there are more."""
    clean = F.filter(F.transform(names, lambda x: strip(text_or_empty(x))), lambda x: x != "")
    line = F.array_join(F.slice(clean, 1, shown), ", ")
    return F.when(F.size(clean) > shown, F.concat(line, F.lit(" et al."))).otherwise(line)


def first_meaningful_line(c: Column) -> Column:
    lines = F.transform(F.split(text_or_empty(c), LINE_END), strip)
    return F.get(F.filter(lines, lambda x: F.length(x).between(4, 180)), F.lit(0))


def classify_table(name: Column, headers: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", text_or_empty(name), headers))
    out = F.lit(None).cast("string")
    for label, words in reversed(vocab.TABLE_CLASSES):
        out = F.when(hay.rlike("|".join(words)), label).otherwise(out)
    return out


def inverted_index_text(index: Column) -> Column:
    """Rebuild a text from {token: [positions]}."""
    entries = F.map_entries(index)
    placed = F.flatten(
        F.transform(
            F.filter(entries, lambda e: e["value"].isNotNull()),
            lambda e, i: F.transform(
                F.filter(e["value"], lambda p: p.isNotNull()),
                lambda p: F.struct(p.alias("pos"), i.alias("ord"), e["key"].alias("token")),
            ),
        )
    )
    # sort_array compares natively, array_sort by an interpreted lambda
    text = F.array_join(F.transform(F.sort_array(placed), lambda s: s["token"]), " ")
    return F.coalesce(text, F.lit(""))


def _index_of(lists: pa.ListArray) -> pa.MapArray:
    """For each list of lists of tokens, its different tokens and their positions."""
    inner = lists.flatten()
    outer, edges = lists.offsets.to_numpy() - lists.offsets[0].as_py(), inner.offsets.to_numpy() - inner.offsets[0].as_py()
    coded = inner.flatten().dictionary_encode()
    sizes = np.diff(edges)
    row = np.repeat(np.repeat(np.arange(len(lists)), np.diff(outer)), sizes)
    pos = np.arange(len(coded)) - np.repeat(edges[:-1], sizes)
    key = row * np.int64(max(len(coded.dictionary), 1)) + coded.indices.to_numpy()
    order = np.lexsort((pos, key))
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    words = coded.dictionary.take(pa.array(key[first] % max(len(coded.dictionary), 1)))
    positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)], pa.int32()), pa.array(pos[order], pa.int32()))
    return pa.MapArray.from_arrays(pa.array(np.searchsorted(row[order][first], np.arange(len(lists) + 1)), pa.int32()), words, positions)


def inverted_index(lists: Column) -> Column:
    """{token: [positions]} of lists of tokens, positions counted in each list. It is made where the row is, with numpy; a
    filter on it stays above it, else it would be made twice."""
    @F.arrow_udf("map<string,array<int>>")
    def made(rows: pa.Array) -> pa.Array:
        parts = [_index_of(pa.concat_arrays([rows.slice(at, 64)])) for at in range(0, len(rows), 64)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.map_(pa.string(), pa.list_(pa.int32())))

    return made.asNondeterministic()(lists)


def dedupe_key(reference: Column, title: Column, year: Column, title_chars: int | None = None) -> Column:
    """'doi:' plus the reference without a doi.org prefix, else title and year."""
    ref = F.lower(strip(text_or_empty(reference)))
    doi = F.regexp_replace(ref, r"^https?://(dx\.)?doi\.org/", "")
    title_key = F.lower(strip(text_or_empty(title)))
    if title_chars is not None:
        title_key = F.substring(title_key, 1, title_chars)
    by_title = F.concat(F.lit("tt:"), title_key, F.lit("|"), F.coalesce(year.cast("string"), F.lit("None")))
    return F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(by_title)


def source_key(c: Column) -> Column:
    return F.lower(strip(text_or_empty(c)))


def elements(c: Column, limit: int | None = None) -> Column:
    """Distinct known chemical symbols in order of appearance."""
    found = F.regexp_extract_all(text_or_empty(c), F.lit(r"(?U)\b([A-Z][a-z]?)\b"), F.lit(1))
    known = F.filter(found, lambda x: x.isin(vocab.ELEMENTS))
    distinct = F.array_distinct(known)
    return distinct if limit is None else F.slice(distinct, 1, limit)


def citation_id(c: Column) -> Column:
    """' [s3] ' -> 'S3'."""
    return F.regexp_replace(F.upper(strip(text_or_empty(c))), r"^\[+|\]+\z", "")


def evidence_key(key: Column, kind: Column, source_id: Column) -> Column:
    """An explicit key, lower case, else kind:id for positive ids, else null."""
    explicit = F.nullif(F.lower(collapse(key)), F.lit(""))
    kind_text = F.lower(collapse(F.coalesce(F.nullif(kind, F.lit("")), F.lit("source"))))
    by_id = F.when(source_id > 0, F.concat(kind_text, F.lit(":"), source_id.cast("string")))
    return F.coalesce(explicit, by_id)


def summary_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(text_or_empty(c), r"[^\p{L}\p{N}]", ""))


def title_only(summary: Column, candidates: Column) -> Column:
    """True if a summary says no more than one of the candidate titles."""
    return let(_title_keys(candidates), lambda keys: _repeats_title(summary, keys))


def _title_keys(candidates: Column) -> Column:
    return F.filter(F.transform(candidates, summary_key), lambda k: k != "")


def _repeats_title(summary: Column, keys: Column) -> Column:
    def near(key):
        return (F.length(key) < 12) | F.exists(
            keys,
            lambda k: (key == k)
            | ((F.length(key) <= F.length(k) + 12) & (key.startswith(k) | k.startswith(key))))

    return let(summary_key(summary), near)


def summary_fragment(c: Column) -> Column:
    """A sentence worth showing (24 characters, 12 of them letters), else null."""
    def keep(text):
        letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
        return F.when((F.length(text) >= 24) & (letters >= 12), text)

    return let(F.regexp_replace(collapse(c), r"""^[ \-:;,.'"]+|[ \-:;,.'"]+\z""", ""), keep)


def heuristic_summary(text: Column, titles: Column) -> Column:
    """The first two distinct sentences among the first six good ones, cut to 220
    characters; null if nothing is good enough or it only repeats a title."""
    blocks = F.split(text_or_empty(text), r"\n{2,}")
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(b, rf"(?<=[.!?]){SPACE}+")))
    fragments = F.filter(F.transform(sentences, summary_fragment), lambda s: s.isNotNull())

    def with_titles(keys):
        six = F.slice(F.filter(fragments, lambda s: ~_repeats_title(s, keys)), 1, 6)
        line = F.array_join(F.slice(distinct_ignoring_case(six), 1, 2), " ")
        return let(trim_at_word(line), lambda out: F.when((out != "") & ~_repeats_title(out, keys), out))

    return let(_title_keys(titles), with_titles)


def labelled(label: str, value: Column) -> Column:
    """'Label: value' or null."""
    text = collapse(value)
    return F.when(text != "", F.concat(F.lit(label + ": "), text))


def _clean_items(values: Column) -> Column:
    return F.filter(F.transform(values, collapse), lambda x: x != "")


def inline_list(label: str, values: Column, separator: str = ", ") -> Column:
    items = _clean_items(values)
    return F.when(F.size(items) > 0, F.concat(F.lit(label + ": "), F.array_join(items, separator)))


def bullet_list(label: str, values: Column) -> Column:
    items = F.transform(_clean_items(values), lambda x: F.concat(F.lit("- "), x))
    return F.when(F.size(items) > 0, F.concat(F.lit(label + ":\n"), F.array_join(items, "\n")))


def joined_blocks(label: str, blocks: Column) -> Column:
    items = F.filter(blocks, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(items) > 0, F.concat(F.lit(label + ":\n"), F.array_join(items, "\n\n")))


def compose(*parts: Column) -> Column:
    """Non-empty parts divided by a blank line; null if there is none."""
    return F.nullif(F.concat_ws("\n\n", *parts), F.lit(""))


def _valid_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def salvage_json(c: Column) -> Column:
    """JSON inside a model answer: a fenced block, else all of it, else the part from
    the first '{' to the last '}'. Null if none of them parses."""
    def from_body(body):
        start = F.instr(body, "{")
        end = F.length(body) - F.instr(F.reverse(body), "}") + 1
        braced = F.when((start > 0) & (F.instr(body, "}") > 0) & (end > start),
                        F.substring(body, start, end - start + 1))
        return F.when(_valid_json(body), body).when(_valid_json(braced), braced)

    def unfenced(text):
        fenced = strip(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1))
        return F.when(text.rlike(r"(?s)```.*```"), fenced).otherwise(text)

    return let(let(strip(text_or_empty(c)), unfenced), from_body)


def count_numbers(c: Column) -> Column:
    return F.regexp_count(collapse(c), F.lit(r"\b\d+(?:[.,]\d+)?\b"))


def is_integer(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"\A[+-]?(?:0|[1-9][0-9]{0,17})\z"))


def is_decimal(c: Column) -> Column:
    """Digits with a point or a single comma and at most 15 of them, or such with an exponent."""
    return F.regexp_like(c, F.lit(r"\A[+-]?(?=[0-9.,]{1,16}(?:[eE]|\z))(?:0|[1-9][0-9]*)(?:[.,][0-9]+)?(?:[eE][+-]?[0-9]{1,2})?\z"))


def _iso_date(c: Column) -> Column:
    """YYYY-MM-DD of a day as 2024-03-01 or 01.03.2024, with a time of day after it as it is; null if there is none."""
    # the form is judged first: few values are days, and only those are rewritten
    form = F.regexp_like(c, F.lit(r"\A(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?\z"))
    parts = F.regexp_replace(c, r"\A([0-9]{2})\.([0-9]{2})\.([0-9]{4})", "$3-$2-$1")
    day = F.substring(parts, 1, 10)
    return F.when(form & day.try_cast("date").isNotNull(), F.regexp_replace(parts, " ", "T"))


def is_date(c: Column) -> Column:
    return _iso_date(c).isNotNull()


def cell_json(c: Column, kind: Column) -> Column:
    """A cell as JSON text: a number, a day in ISO form, a string, or null."""
    text = F.to_json(F.struct(c.alias("v")))
    quoted = F.substring(text, F.lit(6), F.length(text) - 6)
    number = F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"\A\+", "")
    value = (F.when(kind == "integer", number).when(kind == "decimal", number.cast("double").cast("string"))
             .when(kind == "date", F.concat(F.lit('"'), _iso_date(c), F.lit('"'))).otherwise(quoted))
    return F.when(c.isNull(), "null").otherwise(value)


def cell_value(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def query_text(topic: Column, kpi: Column, metric: Column, domain: Column, constraints: Column) -> Column:
    """Topic first if there is one, else the goal with its constraints."""
    def opt(c):
        return F.nullif(c, F.lit(""))

    return F.when(
        strip(text_or_empty(topic)) != "",
        F.concat_ws(" ", opt(topic), opt(kpi), opt(metric), opt(domain)),
    ).otherwise(F.concat_ws(" ", opt(kpi), opt(metric), opt(domain), opt(constraints)))


def direction_verb(direction: Column) -> Column:
    value = F.coalesce(F.nullif(direction, F.lit("")), F.lit("increase"))
    return F.when(value == "increase", "увеличить").otherwise("снизить")


def kpi_line(metric: Column, direction: Column, domain: Column) -> Column:
    first = F.when(
        text_or_empty(metric) != "",
        F.concat(F.lit("Метрика: "), metric, F.lit(" ("), direction_verb(direction), F.lit(")")),
    )
    second = F.when(text_or_empty(domain) != "", F.concat(F.lit("Область: "), domain))
    return F.concat_ws(" · ", first, second)


def status_label(status: Column) -> Column:
    out = status
    for key, label in vocab.STATUS_LABELS.items():
        out = F.when(status == key, label).otherwise(out)
    return out


def file_type(name: Column) -> Column:
    """Type by extension; an unknown extension is its own type, none is 'unknown'."""
    base = F.regexp_extract(text_or_empty(name), r"([^/]*)\z", 1)
    ext = F.lower(F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)\z", 1))
    out = F.coalesce(F.nullif(F.regexp_replace(ext, r"^\.+", ""), F.lit("")), F.lit("unknown"))
    for key, value in vocab.FILE_TYPES.items():
        out = F.when(ext == key, value).otherwise(out)
    return out


def library_type(source_type: Column, origin: Column, position: Column) -> Column:
    """Library card type; untyped sources alternate by position (arbitrary but fixed)."""
    return (
        F.when(source_type == "patent", "patent")
        .when(source_type.isin("report", "experiment"), "technical")
        .when(origin == "openalex", "article")
        .when(position % 2 == 0, "article")
        .otherwise("literature")
    )


def year_bucket(year: Column) -> Column:
    return F.when(year.between(2024, 2026), year.cast("string")).otherwise("earlier")
