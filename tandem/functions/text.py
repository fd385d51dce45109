"""Text functions as Column expressions: cleaners, token filters, tokenizers, n-grams.

Every filter takes a Column of one token and gives a Column; ``FILTERS`` finds them by name, so a pipeline is a list
of names. Only the stemmer is a vectorised UDF, meant to run on distinct tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: patterns and names of the text rules --------------------------------------------------------
NON_ALNUM = r"[^\p{L}\p{N}]+"
HTML_NAMES = r"((&quot)|(&gt)|(&lt)|(&amp)|(&nbsp)|(&copy)|(&reg))+"
#: What ends a token that is no number: other signs, and the numbers of ASCII digits among them.
NON_ALNUM_OR_NUMBER = r"[^\p{L}\p{N}]++(?:[0-9]++(?![\p{L}\p{N}])[^\p{L}\p{N}]*+)*+"
MODULE = r"^[a-zA-Z][a-zA-Z0-9]+(\.[a-zA-Z][a-zA-Z0-9]+)+(\(\))?$"
MODULE_SYMBOL = "#MODULE_FUNCTION"
URL_START = r"^((https?://)|(www\.))[^\s]+$"
URL_END = r"^[^\s]+(\.com|\.net|\.org)([/?]([-a-zA-Z0-9@;:%_+.~#?&/=]*))?$"
URL_SYMBOL = "#URL"
EDGE_PUNCT = r"(^[\]\d!\"#$%&'()*+,\-./:;<=>?@\[\^_`{|}~]+)|([\]\d!\"#$%&'()*+,\-./:;<=>?@\[\^_`{|}~]+$)"
TIME = r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}"
DATE = r"[0-9]{1,4}([/-])[0-9]{1,2}\1[0-9]{2,4}"
CLASS_HEAD = r"((public|private)\s*)?class\s+(\w+)(\s+extends\s+(\w+))?(\s+implements\s+([\w,\s]+))?\s+\{(\s*\})?"
CALL_BODY = r"\w+\s*\([^)]*\)\s*\{"
IF_BODY = r"if\s*\(.*\{"
NEW_OBJECT = r"\w\s*=\snew[^;]+;"
#: The Treebank tokenizer's rules in their order: pattern, replacement (\\0 the match, \\1 a group), whether case counts.
TREEBANK = (
    (r"^\"", "``", True),
    (r"(``)", r" \1 ", True),
    (r"([ (\[{<])(\"|'{2})", r"\1 `` ", True),
    (r"([:,])([^0-9])", r" \1 \2", True),
    (r"([:,])\z", r" \1 ", True),
    (r"\.\.\.", " ... ", True),
    (r"[;@#$%&]", r" \0 ", True),
    (r"([^.])(\.)([\])}>\"']*)[ \t\n\x0B\f\r]*\z", r"\1 \2\3 ", True),
    (r"[?!]", r" \0 ", True),
    (r"([^'])' ", r"\1 ' ", True),
    (r"[\]\[(){}<>]", r" \0 ", True),
    (r"--", " -- ", True),
    (r"(?s)\A(.*)\z", r" \1 ", True),
    (r"\"", " '' ", True),
    (r"([^ \t\n\x0B\f\r])('')", r"\1 \2 ", True),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 ", True),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 ", True),
    (r"\b(can)(not)\b", r" \1 \2 ", False),
    (r"\b(d)('ye)\b", r" \1 \2 ", False),
    (r"\b(gim)(me)\b", r" \1 \2 ", False),
    (r"\b(gon)(na)\b", r" \1 \2 ", False),
    (r"\b(got)(ta)\b", r" \1 \2 ", False),
    (r"\b(lem)(me)\b", r" \1 \2 ", False),
    (r"\b(more)('n)\b", r" \1 \2 ", False),
    (r"\b(wan)(na) ", r" \1 \2 ", False),
    (r" ('t)(is)\b", r" \1 \2 ", False),
    (r" ('t)(was)\b", r" \1 \2 ", False),
)
EMPTY_TOKEN = "#EMPTY"
PAD_SENTINEL = "PPPAAADDD"
QUOTE = r"^[\"`']$"


def lower(t: Column) -> Column:
    return F.lower(t)


def digits_to_zero(t: Column) -> Column:
    return F.regexp_replace(t, "[0-9]", "0")


def html_names(t: Column) -> Column:
    return F.regexp_replace(t, HTML_NAMES, "")


def module_symbol(t: Column) -> Column:
    return F.regexp_replace(t, MODULE, MODULE_SYMBOL)


def non_alnum(t: Column, by: str = " ") -> Column:
    return F.regexp_replace(t, NON_ALNUM, by)


def url_symbol(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, URL_START, URL_SYMBOL), URL_END, URL_SYMBOL)


def collapse_punct(t: Column) -> Column:
    """A token that is one repeated sign shrinks: signs to one, dots to three or one, dashes to two."""
    t = F.regexp_replace(t, r"^([,:;><!?=_\\/])\1+$", "$1")
    t = F.regexp_replace(t, r"^\.{4,}$", "...")
    t = F.regexp_replace(t, r"^\.{2}$", ".")
    return F.regexp_replace(t, r"^-{3,}$", "--")


def strip_punct(t: Column) -> Column:
    return F.regexp_replace(t, EDGE_PUNCT, "")


def share_of_signs(t: Column) -> Column:
    """Share of digits and ASCII punctuation among a string's characters."""
    return F.length(F.regexp_replace(t, r"[^\p{N}\p{Punct}]", "")) / F.length(t)


def drop_unusual(t: Column) -> Column:
    """Empty where more than 20 % of the characters are digits or punctuation."""
    return F.when((F.length(t) > 0) & (share_of_signs(t) > 0.2), "").otherwise(t)


def stop_words(extra: tuple[str, ...] = ("n't", "'t")) -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return [*StopWordsRemover.loadDefaultStopWords("english"), *extra]


def drop_stop_words(t: Column, words: tuple[str, ...] | None = None) -> Column:
    return F.when(t.isin(*(words or stop_words())), "").otherwise(t)


FILTERS: dict[str, Callable[[Column], Column]] = {
    "TransformLowerCaseFilter": lower,
    "TransformNumberToZeroFilter": digits_to_zero,
    "HTMLSymbolFilter": html_names,
    "StopWordRemoval": drop_stop_words,
    "ModuleFunctionFilter": module_symbol,
    "NonAlphaNumericalChar": non_alnum,
    "UrlFilter": url_symbol,
    "RepeatedPunctuationFilter": collapse_punct,
    "StripPunctuactionFilter": strip_punct,
    "DectectNotUsualWordFilter": drop_unusual,
}


def load_filters(names: list[str]) -> list[Callable[[Column], Column]]:
    missing = [n for n in names if n not in FILTERS and n != "NeutralQuotesFilter"]
    if missing:
        raise ValueError(f"unknown filters: {missing}")
    return [FILTERS[n] for n in names if n in FILTERS]


def non_empty(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def tokens_alnum(text: Column) -> Column:
    """Runs of letters and digits."""
    return non_empty(F.split(text, NON_ALNUM))


def tokens_space(text: Column) -> Column:
    return non_empty(F.split(text, r"\s+"))


def treebank(sentence: Column) -> Column:
    """Tokens of one sentence by the Penn Treebank conventions: quotes are paired, clitics and signs stand alone, and of
    dots only the last."""
    for pattern, by, case in TREEBANK:
        by = re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$"))
        sentence = F.regexp_replace(sentence, pattern if case else f"(?i){pattern}", by)
    return tokens_space(sentence)


def tokens_words(text: Column) -> Column:
    """Treebank tokens of every sentence."""
    return F.flatten(F.transform(sentences(text), treebank))


TOKENIZERS = {"default": tokens_words, "white_space": tokens_space, "non_alnum": tokens_alnum}


def apply_filters(tokens: Column, filters: list[Callable[[Column], Column]]) -> Column:
    """Filters each token in turn; tokens that end empty go."""

    def chain(t: Column) -> Column:
        for f in filters:
            t = f(t)
        return t

    return non_empty(F.transform(tokens, chain))


def neutral_quotes(tokens: Column) -> Column:
    """Single quote tokens of a sentence become opening and closing quotes in turn."""
    start = F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, t: Column) -> Column:
        quote = t.rlike(QUOTE)
        mark = F.when(~quote, t).when(state["open"], "``").otherwise("''")
        return F.struct((state["open"] != quote).alias("open"), F.concat(state["out"], F.array(mark)).alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a space; empty if there are fewer."""
    if n == 1:
        return tokens
    if n == 2:
        return F.filter(F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda t: t.isNotNull())
    last = F.size(tokens) - n + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def dbrd_tokens(text: Column, drop_stops: bool = True) -> Column:
    """Retrieval tokens before stemming: lower case, no entity names, alphanumeric runs, no numbers, no stop words."""
    low = F.lower(text)
    named = F.when(F.contains(low, F.lit("&")), html_names(low)).otherwise(low)
    # one split leaves out the numbers too, so no expression runs for each token
    tokens = F.array_remove(F.split(F.concat(F.lit(" "), named), NON_ALNUM_OR_NUMBER), "")
    if drop_stops:
        tokens = F.filter(tokens, lambda t: ~t.isin(stop_words(())))  # a set, which is not searched word by word
    return tokens


def or_empty_token(tokens: Column) -> Column:
    """The tokens, which are computed once, or the empty token."""
    return F.get(F.transform(F.array(tokens), lambda t: F.when(F.size(t) == 0, F.array(F.lit(EMPTY_TOKEN))).otherwise(t)), F.lit(0))


def trimmed(text: Column) -> Column:
    """Stripped text, empty for null."""
    return F.coalesce(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def summary_and_description(summary: Column, description: Column, sep: str = "\n") -> Column:
    return F.concat(trimmed(summary), F.lit(sep), F.coalesce(description, F.lit("")))


def clean_aggressive(text: Column) -> Column:
    """Drops code heads, times, dates and repeated signs, then keeps lines of 10 characters, 5 tokens and at most
    20 % digits and signs; every kept line ends with a line end."""
    t = text
    for pattern in (CLASS_HEAD, IF_BODY, CALL_BODY, NEW_OBJECT, TIME, DATE):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, r"([,:;><!?=_\\/*-.])\1+", "$1")

    def keep(line: Column) -> Column:
        return (F.length(line) >= 10) & (F.size(tokens_space(line)) >= 5) & (share_of_signs(line) <= 0.2)

    lines = F.filter(F.split(t, "\n"), keep)
    return F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "")


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space and a capital or digit (a documented subset of Punkt)."""
    return F.split(F.regexp_replace(text, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}])", "\u0001"), "\u0001")


def clean_soft(text: Column, rm_punct: bool = False, sent_tok: bool = False, rm_number: bool = False, stops: bool = False, lower_case: bool = False, rm_char: bool = False, legacy_sent_tok: bool = True, stem: bool = False) -> Column:
    """Light cleaning with switches. With ``legacy_sent_tok`` sentence splitting starts from the text before the
    removal of signs, times and dates, as published corpora were made."""
    raw = F.lower(text) if lower_case else text
    t = F.regexp_replace(raw, r"([\p{Punct}&&[^\\]])\1+", "$1")
    t = F.regexp_replace(F.regexp_replace(t, TIME, ""), DATE, "")
    if sent_tok:
        t = F.array_join(sentences(raw if legacy_sent_tok else t), "\n")
    if stops or stem:
        tokens = non_empty(stem_all(tokens_words(t))) if stem else tokens_words(t)
        t = F.array_join(F.filter(tokens, lambda w: ~w.isin(stop_words(("n't",)))) if stops else tokens, " ")
    t = F.regexp_replace(t, r"(\p{Punct})", " " if rm_punct else " $1 ")
    if rm_number:
        t = F.regexp_replace(t, r"\b[0-9]+\b", "")
    if rm_char:
        t = F.regexp_replace(t, r"\b\S\b", "")
    return t


def pad_or_cut(values: Column, n: int, pad) -> Column:
    """Exactly n values: cut behind, filled up behind."""
    return F.concat(F.slice(values, 1, n), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(n) - F.size(values))))


@F.pandas_udf(T.LongType())
def adler32(s: pd.Series) -> pd.Series:
    import zlib

    return s.map(lambda x: None if x is None else zlib.adler32(x.encode()))


def hash_code(token: Column, size: int) -> Column:
    """Token number of a hash lexicon."""
    return F.pmod(adler32(token), F.lit(size))


@F.pandas_udf(T.StringType())
def stem(s: pd.Series) -> pd.Series:
    """English stems; give it distinct tokens."""
    from .stemmer import stem_word

    return s.map(lambda w: None if w is None else stem_word(w))


def stem_all(tokens: Column) -> Column:
    """English stems of token arrays; each distinct token of a batch is stemmed once, stop words stay."""
    keep = frozenset(stop_words(()))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stems(lists: pa.Array) -> pa.Array:
        from .stemmer import stem_word

        # words become codes and stems again without a Python string for each of them
        words = lists.flatten().dictionary_encode()
        known = pa.array([w if w is None or w in keep else stem_word(w) for w in words.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), known.take(words.indices), mask=pc.is_null(lists) if lists.null_count else None)

    return stems(tokens)


def retrieval_tokens(text: Column, stops: bool = True, stems: bool = True) -> Column:
    """The retrieval pipeline whole: ``dbrd_tokens`` without stop words, then stems that are not empty."""
    tokens = dbrd_tokens(text, drop_stops=stops)
    return non_empty(stem_all(tokens)) if stems else tokens


CLEANERS = ("agg", "soft", "rep")


def cleaner(kind: str, sentences_too: bool = False, **switches) -> Callable[[Column], Column]:
    """A cleaner by name: ``agg`` (lines of code and signs go), ``soft`` (with the switches of ``clean_soft``) or ``rep`` (stems of
    retrieval tokens). ``sentences_too`` splits sentences, which only the soft cleaner does."""
    if kind == "agg":
        return clean_aggressive
    if kind == "soft":
        return lambda c: clean_soft(c, sent_tok=sentences_too, **switches)
    if kind == "rep":
        return lambda c: F.array_join(retrieval_tokens(c), " ")
    raise ValueError(f"unknown cleaner {kind}: one of {', '.join(CLEANERS)}")


def clean_job(df, fields: list[str], kind: str, sentences_too: bool = False, **switches):
    """The rows with the chosen fields cleaned; sentences are split in ``description`` alone. Null and empty fields stay as they are."""

    def one(field: str) -> Callable[[Column], Column]:
        clean = cleaner(kind, sentences_too and field == "description", **switches)
        return lambda c: F.when(F.length(c) > 0, clean(c)).otherwise(c)

    return clean_fields(df, {f: one(f) for f in fields})


def clean_fields(df, cleaners: dict[str, Callable[[Column], Column]]):
    """The rows with each named field cleaned by its own cleaner."""
    return df.withColumns({f: clean(F.col(f)) for f, clean in cleaners.items()})


def erased_counts(df, cleaners: dict[str, Callable[[Column], Column]]):
    """(field, n, n_erased): of each field, how many texts are blank only after cleaning; one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), (F.trim(F.coalesce(clean(F.col(f)), F.lit(""))) == "").alias("blank"), (F.trim(F.coalesce(F.col(f), F.lit(""))) == "").alias("was")) for f, clean in cleaners.items()])
    each = df.select(F.explode(cells).alias("c")).select("c.*")
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("blank") & ~F.col("was")).alias("n_erased"))
