"""Full-text search: an inverted index, boolean queries, BM25, snippets and fuzzy terms."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLAIN, STOP_WORDS, TURKISH, fuzzy_match, words
from ..plans.shared import materialize
from .filters import Catalog, ListOptions, apply_filters, sort_by

#: BM25 parameters, the length from which a word is a prefix, and operator words. (Turkish
#: "ve" is a plain word: it stands in ordinary sentences, and words side by side must all occur anyway.)
K1, B, PREFIX = 1.2, 0.75, 4
#: Keys of hits that are broadcast at most, to take their texts before these are shuffled; beyond that all texts are.
BROADCAST_KEYS = 1 << 20
OPERATORS = {"and": "AND", "or": "OR", "veya": "OR", "not": "NOT", "değil": "NOT", "degil": "NOT"}


def token_index(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The inverted index: (term, key, field, positions, length of the field)."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), words(F.col(f)).alias("tokens")) for f in fields)))
    rows = lambda part: part.select(F.col(key), each.alias("f")).select(key, "f.field", F.size("f.tokens").alias("length"), "f.tokens")
    return _merged(df, key, lambda part: _postings_in_rows(rows(part))).select("term", key, "field", "length", "positions")


def _postings_in_rows(rows: DataFrame) -> DataFrame:
    """Rows with tokens to a row per term with its positions. A row's tokens are sorted within it, so nothing is
    shuffled."""
    names = [c for c in rows.columns if c != "tokens"]
    spots = F.array_sort(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("position"))))
    rows = rows.filter(F.size("tokens") > 0).select(*names, spots.alias("spots"))
    first = lambda i: (i == 0) | (F.get("spots", i)["term"] != F.get("spots", i - 1)["term"])
    rows = rows.select(*names, "spots", F.filter(F.sequence(F.lit(0), F.size("spots") - 1), first).alias("heads"))
    own = lambda h, i: F.slice("spots", h + 1, F.coalesce(F.get("heads", i + 1), F.size("spots")) - h)["position"]
    terms = F.transform("heads", lambda h, i: F.struct(F.get("spots", h)["term"].alias("term"), own(h, i).alias("positions")))
    return rows.select(*names, F.explode(terms).alias("t")).select(*names, "t.term", "t.positions")


def _merged(df: DataFrame, key: str, postings: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The postings of all rows; those of rows that share a key are one where all else is equal. Only such rows are
    shuffled, and none where each key stands once."""
    own = F.col(f"`{key}`")
    repeated = df.groupBy(own.alias("__repeated")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__repeated")
    if repeated.isEmpty():
        return postings(df)
    same = own.eqNullSafe(F.col("__repeated"))
    many = postings(df.join(repeated, same, "left_semi"))
    positions = F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")
    many = many.groupBy(*(c for c in many.columns if c != "positions")).agg(positions)
    return postings(df.join(repeated, same, "left_anti")).unionByName(many)


@dataclass
class TextIndex:
    """Postings in segments in order of (term, key), and the corpus's statistics; searches read no text."""

    postings: DataFrame  # term, key, field, positions, doc_length
    fields: list[str]
    n: int
    mean: float


def build_index(df: DataFrame, key: str, fields: list[str]) -> TextIndex:
    """Write the index of some fields to the shared folder. Each task writes a segment of its rows' postings in order
    of term and key, so a search reads the pages of its terms alone, a hot term spans all segments, and postings are
    not shuffled."""
    tokens = [words(F.col(f"`{f}`")) for f in fields]

    def postings(part: DataFrame) -> DataFrame:
        sized = part.select(F.col(f"`{key}`").alias("key"), *(t.alias(f"t{i}") for i, t in enumerate(tokens)))
        sized = sized.withColumn("doc_length", sum((F.size(f"t{i}") for i in range(len(fields))), F.lit(0)))
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"t{i}").alias("tokens")) for i, f in enumerate(fields))))
        return _postings_in_rows(sized.select("key", "doc_length", each.alias("f")).select("key", "doc_length", "f.field", "f.tokens"))

    rows = _merged(df, key, postings).select("term", "key", "field", "doc_length", "positions")
    written = materialize(rows.sortWithinPartitions("term", "key"), "text-index")
    stats = df.select(sum((F.size(t) for t in tokens), F.lit(0)).alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    return TextIndex(written, fields, stats["n"], stats["mean"] or 1.0)


@dataclass(frozen=True)
class Term:
    text: str  # one word, or words of a phrase
    phrase: bool = False
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    op: str  # AND, OR or NOT (the first without the others)
    parts: tuple


def _split(query: str) -> list[tuple[str, str]]:
    """(kind, text) of words, quoted phrases (an open one ends with the query) and parentheses."""
    found = re.findall(r'"([^"]*)(?:"|$)|([()])|([^\s()"]+)', query)
    return [("phrase", p.strip()) if not a and not w else ("paren", a) if a else ("word", w) for p, a, w in found if a or w or p.strip()]


def parse_query(query: str):
    """A tree of Node and Term, or None for a blank query.

    Words side by side must all occur and bind tightest, then NOT, AND and OR. Where an operator lacks a
    side, or parentheses do not match, all words are taken literally.
    """
    parts = _split(query)
    if not parts:
        return None
    op = lambda p: OPERATORS.get(p[1].lower().replace("̇", "")) if p[0] == "word" else None
    edges = [None, *(op(p) or p[1] if op(p) or p[0] == "paren" else "term" for p in parts), None]
    names = {"AND", "OR", "NOT"}
    bad = any(e in names and (edges[i - 1] in (None, "(") or edges[i - 1] in names or edges[i + 1] in (None, ")") or edges[i + 1] in names) for i, e in enumerate(edges))
    depth = 0
    for e in edges:
        depth += (e == "(") - (e == ")")
        bad |= depth < 0
    if bad or depth:
        terms = [Term(" ".join(words_of(w)), len(words_of(w)) > 1) for p in parts if p[0] != "paren" for w in (p[1].split() if p[0] == "word" else [p[1]]) if words_of(w)]
        return Node("AND", tuple(terms)) if terms else None
    at = 0

    def unit():
        nonlocal at
        kind, text = parts[at]
        at += 1
        if (kind, text) == ("paren", "("):
            inner = level(0)
            at += 1
            return inner
        own = words_of(text)
        if not own:
            return None
        return Term(" ".join(own), True) if kind == "phrase" or len(own) > 1 else Term(own[0], prefix=len(own[0]) >= PREFIX)

    def level(n: int):
        nonlocal at
        name = ("OR", "AND", "NOT", "")[n]
        found = [level(n + 1) if n < 3 else unit()]
        while at < len(parts) and parts[at] != ("paren", ")"):
            if name:
                if op(parts[at]) != name:
                    break
                at += 1
                found.append(level(n + 1))
            elif op(parts[at]):
                break
            else:
                found.append(unit())
        found = [f for f in found if f is not None]
        return None if not found else found[0] if len(found) == 1 else Node(name or "AND", tuple(found))

    return level(0)


def words_of(text: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}\p{M}]+", text.lower())


def matches(tree, fields: list[str]) -> Column:
    """Whether a row's fields meet a query: terms in any field, a phrase within one."""
    if isinstance(tree, Node):
        parts = [matches(p, fields) for p in tree.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if tree.op == "AND" else out | p if tree.op == "OR" else out & ~p
        return out
    out = F.lit(False)
    for f in fields:
        tokens = words(F.col(f))
        if tree.phrase:
            hit = F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {tree.text} "))
        elif tree.prefix:
            hit = F.exists(tokens, lambda t: F.startswith(t, F.lit(tree.text)))
        else:
            hit = F.array_contains(tokens, tree.text)
        out = out | hit
    return out


def search(df: DataFrame, query: str, fields: list[str], synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows that meet a query; a blank one all rows. Without any, words are widened by synonyms."""
    tree = parse_query(query)
    if tree is None:
        return df
    found = df.filter(matches(tree, fields))
    more = synonyms_of(query, synonyms or {})
    if not more or not found.isEmpty():
        return found
    return df.filter(matches(Node("OR", tuple(Term(w, " " in w) for w in [*words_of(query), *more])), fields))


def leaves(tree, positive: bool = True) -> list[tuple[Term, bool]]:
    """The terms of a query, and whether each is asked for (not after NOT)."""
    if isinstance(tree, Term):
        return [(tree, positive)]
    return [x for i, p in enumerate(tree.parts) for x in leaves(p, positive and (tree.op != "NOT" or i == 0))]


def _term_hits(index: TextIndex, terms: list[Term]) -> DataFrame:
    """(key, doc_length, h0, h1, ...): hits of each term in each field, as an array; one row per key."""
    term = F.col("term")
    exact = sorted({w for t in terms if not t.prefix for w in t.text.split()})
    asked = term.isin(exact) if exact else F.lit(False)
    for p in sorted({t.text for t in terms if t.prefix}):
        asked = asked | F.startswith(term, F.lit(p))
    spots: dict[tuple[str, str], Column] = {}

    def hits(t: Term, field: str) -> Column:
        own = F.col("field") == field
        if not t.phrase:
            match = F.startswith(term, F.lit(t.text)) if t.prefix else term == t.text
            return F.sum(F.when(own & match, F.size("positions")).otherwise(0)).cast("int")
        found = [spots.setdefault((field, w), F.coalesce(F.max(F.when(own & (term == w), F.col("positions"))), F.array().cast("array<int>"))) for w in t.text.split()]

        def whole(at: Column) -> Column:
            out = F.lit(True)
            for i, other in enumerate(found[1:], 1):
                out = out & F.array_contains(other, at + i)
            return out

        return F.size(F.filter(found[0], whole))

    return index.postings.filter(asked).groupBy("key").agg(F.max("doc_length").alias("doc_length"), *(F.array(*(hits(t, f) for f in index.fields)).alias(f"h{i}") for i, t in enumerate(terms)))


def _holds(tree, number: dict[Term, int]) -> Column:
    if isinstance(tree, Term):
        return F.exists(f"h{number[tree]}", lambda n: n > 0)
    out = _holds(tree.parts[0], number)
    for p in tree.parts[1:]:
        own = _holds(p, number)
        out = out & own if tree.op == "AND" else out | own if tree.op == "OR" else out & ~own
    return out


def search_index(index: TextIndex, query: str, synonyms: dict[str, list[str]] | None = None) -> DataFrame | None:
    """(key, score, sources) of the rows that meet a query; None for a blank one.

    score is BM25 over all fields; sources names the fields that hold a term asked for. Without any row,
    words are widened by synonyms: keys are whole words or word sequences of the query.
    """
    tree = parse_query(query)
    if tree is None:
        return None
    found = _scored(index, tree)
    more = synonyms_of(query, synonyms or {})
    if not more or not found.isEmpty():
        return found
    return _scored(index, Node("OR", tuple(Term(w, " " in w, " " not in w and len(w) >= PREFIX) for w in [*words_of(query), *more])))


def _scored(index: TextIndex, tree) -> DataFrame:
    marked = leaves(tree)
    terms = list(dict.fromkeys(t for t, _ in marked))
    wanted = [i for i, t in enumerate(terms) if (t, True) in marked]
    rows = _term_hits(index, terms)
    total = {i: F.aggregate(f"h{i}", F.lit(0), lambda a, b: a + b) for i in wanted}
    held = rows.agg(*(F.count_if(total[i] > 0).alias(f"d{i}") for i in wanted)).first()  # a count per term
    score = F.lit(0.0)
    for i in wanted:
        idf = math.log(1 + (index.n - held[f"d{i}"] + 0.5) / (held[f"d{i}"] + 0.5))
        score = score + idf * total[i] * (K1 + 1) / (total[i] + K1 * (1 - B + B * F.col("doc_length") / index.mean))
    hit = F.array(*(F.when(sum((F.col(f"h{i}")[k] for i in wanted), F.lit(0)) > 0, F.lit(f)) for k, f in enumerate(index.fields)))
    found = rows.filter(_holds(tree, {t: i for i, t in enumerate(terms)}))
    return found.select("key", score.alias("score"), F.filter(hit, lambda f: f.isNotNull()).alias("sources"))


def plain_tokens(query: str) -> list[str]:
    """The significant words of a query with plain letters, each once, in order."""
    table = str.maketrans(TURKISH, PLAIN)
    stop = {w.translate(table) for w in STOP_WORDS}
    return list(dict.fromkeys(t for t in words_of(query.translate(table)) if len(t) >= 3 and t not in stop))


def expanded_tokens(query: str, vocabulary: dict[str, list[str]], most: int = 20) -> list[str]:
    """The first new significant words that a vocabulary has for a query, in its order.

    A key of one word asks for that whole word, so "han" is not met by "hangi"; a key of several may stand
    anywhere in the query.
    """
    table = str.maketrans(TURKISH, PLAIN)
    plain = query.translate(table).lower()
    asked, own, more = set(words_of(plain)), plain_tokens(query), []
    for key, others in vocabulary.items():
        wanted = key.translate(table).lower()
        if wanted in (plain if " " in wanted else asked):
            more += [t for other in others for t in plain_tokens(other) if t not in own]
    return list(dict.fromkeys(more))[:most]


def synonyms_of(query: str, synonyms: dict[str, list[str]], most: int = 20) -> list[str]:
    """Other words for those of a query, none that it has itself."""
    asked = words_of(query)
    return [t for t in expanded_tokens(query, synonyms, most) if t not in asked]


def fuzzy_index(index: TextIndex, query: str, fields: list[str]) -> DataFrame:
    """(key) of rows where every word of the query is near some word of the fields; reads postings alone."""
    terms = [w for w in re.split(r'[\s"()]+', query.lower()) if w and w not in OPERATORS]
    near = [fuzzy_match(F.col("term"), w) for w in terms]
    if not near:
        return index.postings.select("key").limit(0)
    any_of = near[0]
    for c in near[1:]:
        any_of = any_of | c
    flags = index.postings.filter(F.col("field").isin(fields) & any_of).groupBy("key").agg(*(F.max(c).alias(f"n{i}") for i, c in enumerate(near)))
    all_of = F.lit(True)
    for i in range(len(near)):
        all_of = all_of & F.col(f"n{i}")
    return flags.filter(all_of).select("key")


def list_search(catalog: Catalog, opts: ListOptions, index: TextIndex, order: str = "modified_desc", synonyms: dict[str, list[str]] | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """The filtered listing that a query asks for, in order: by the sort order without a query or with a
    fuzzy one, else by falling score, ties by id. Adds score and sources (null where no index was asked).

    opts.fuzzy: words near the query's in the fields names. opts.fuzzy_last: so only where the query has
    no row.
    """
    rows, key = apply_filters(catalog, opts), catalog.roles.get("id", "id")
    bare = lambda df: df.withColumns({"score": F.lit(None).cast("double"), "sources": F.lit(None).cast("array<string>")})
    near = lambda: bare(sort_by(rows.join(fuzzy_index(index, opts.query, list(names)).withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left_semi"), catalog, order))
    if opts.query and opts.query.strip() and opts.fuzzy:
        return near()
    hits = search_index(index, opts.query or "", synonyms)
    if hits is None:
        return bare(sort_by(rows, catalog, order))
    found = rows.join(hits.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key")).drop("__key")
    if opts.fuzzy_last and found.isEmpty():
        return near()
    return found.orderBy(F.desc("score"), key)


def keyword_ids(index: TextIndex, keywords: list[str]) -> DataFrame:
    """(key) of rows that hold any of some words or phrases."""
    terms = [Term(" ".join(words_of(k)), len(words_of(k)) > 1) for k in keywords if words_of(k)]
    if not terms:
        return index.postings.select("key").limit(0)
    return _scored(index, Node("OR", tuple(terms)) if len(terms) > 1 else terms[0]).select("key")


def bm25(df: DataFrame, key: str, field: str, terms: list[str]) -> DataFrame:
    """(key, score) of rows that hold some term; statistics over all rows, in two aggregations.

    Term counts are taken in the row, so nothing but counts is shuffled.
    """
    tokens = df.select(key, words(F.col(field)).alias("tokens"))
    tf = [_count("tokens", w) for w in terms]
    rows = tokens.select(key, F.size("tokens").alias("length"), *(c.alias(f"tf{i}") for i, c in enumerate(tf)))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    known = stats.first()  # one row of counts
    score = F.lit(0.0)
    for i in range(len(terms)):
        held, tf = known[f"df{i}"], F.col(f"tf{i}")
        idf = math.log(1 + (known["n"] - held + 0.5) / (held + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / (known["mean"] or 1.0)))
    found = rows.filter(F.greatest(*(F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0)
    return found.select(key, score.alias("score"))


def _count(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word))


def snippet(c: Column, terms: list[str], width: int = 12, marks: tuple[str, str] = ("[", "]")) -> Column:
    """The first window of width words with most hits, hits marked, … where text is left out."""
    tokens = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")
    wanted = F.array(*(F.lit(w) for w in terms))
    flagged = F.transform(tokens, lambda t: F.struct(t.alias("word"), F.when(F.arrays_overlap(words(t), wanted), 1).otherwise(0).alias("hit")))

    def best(row: Column) -> Column:
        last = F.greatest(F.size(row["words"]) - width, F.lit(0))
        spots = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.aggregate(F.slice(row["words"], i + 1, width), F.lit(0), lambda s, x: s + x["hit"]).alias("hits"), (-i).alias("at")))
        return F.struct((-F.array_max(spots)["at"]).alias("at"), row["words"].alias("words"))

    def shown(row: Column) -> Column:
        part = F.transform(F.slice(row["words"], row["at"] + 1, width), lambda t: F.when(t["hit"] == 1, F.concat(F.lit(marks[0]), t["word"], F.lit(marks[1]))).otherwise(t["word"]))
        return F.concat(F.when(row["at"] > 0, "…").otherwise(""), F.array_join(part, " "), F.when(row["at"] + width < F.size(row["words"]), "…").otherwise(""))

    # Arrays of one element name what the steps after them use, so each is computed once.
    return F.transform(F.transform(F.array(F.struct(flagged.alias("words"))), best), shown)[0]


def field_snippets(index: TextIndex, df: DataFrame, key: str, query: str, width: int = 12, marks: tuple[str, str] = ("[", "]")) -> DataFrame:
    """(key, field, snippet) of each field that holds a word asked for, for the rows that meet a query.

    The window of width words that begins at a hit and has most of them, the first of equal ones, comes from the
    stored positions; only hits' texts are read, to show it. Hits are marked, … stands where text is left out.
    """
    found = search_index(index, query)
    tree = parse_query(query)
    if found is None:
        return df.select(F.col(key), F.lit("").alias("field"), F.lit("").alias("snippet")).limit(0)
    asked = F.lit(False)
    for term, positive in leaves(tree):
        for word in term.text.split() if positive else ():
            asked = asked | (F.startswith(F.col("term"), F.lit(word)) if term.prefix else F.col("term") == word)
    hits = index.postings.filter(asked).groupBy("key", "field").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("at"))
    # Positions differ, so no window holds more than the next width of them.
    ahead = lambda p, i: F.size(F.filter(F.slice("at", i + 1, width), lambda q: q < p + width))
    best = F.array_max(F.transform("at", lambda p, i: F.struct(ahead(p, i).alias("n"), (-p).alias("minus"))))
    spots = hits.join(found.select("key"), "key", "left_semi").select("key", "field", "at", (-best["minus"]).alias("first"))
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")).alias("text")) for f in index.fields)))
    spots = materialize(spots, "snippet-spots")
    held, own = spots.select(F.col("key").alias("__key")).distinct(), F.col(f"`{key}`") == F.col("__key")
    if spots.count() <= BROADCAST_KEYS:  # only hits' texts are shuffled
        df = df.join(F.broadcast(held), own, "left_semi")
    rows = df.select(F.col(f"`{key}`").alias("key"), texts.alias("f")).select("key", "f.field", "f.text").join(spots, ["key", "field"])
    word = r"[\p{L}\p{N}\p{M}]+"
    pieces = F.regexp_extract_all("text", F.lit(f"({word}[^\\p{{L}}\\p{{N}}\\p{{M}}]*)"), 1)
    cut = rows.select("key", "field", "at", "first", F.size(pieces).alias("n"), F.slice(pieces, F.col("first") + 1, F.lit(width)).alias("pieces"))
    marked = F.transform("pieces", lambda x, i: F.when(F.array_contains("at", F.col("first") + i), F.regexp_replace(x, f"^({word})", f"\\{marks[0]}$1\\{marks[1]}")).otherwise(x))
    shown = F.regexp_replace(F.array_join(marked, ""), r"[^\p{L}\p{N}\p{M}\]]+$", "")
    text = F.concat(F.when(F.col("first") > 0, "…").otherwise(""), shown, F.when(F.col("first") + width < F.col("n"), "…").otherwise(""))
    return cut.select(F.col("key").alias(key), "field", text.alias("snippet"))


def best_snippet(fields: list[str], terms: list[str], width: int = 12) -> Column:
    """(field, text): the snippet of the field with most hits, the first of equal ones."""
    wanted = F.array(*(F.lit(w) for w in terms))
    counted = F.array(*(F.struct(F.size(F.filter(words(F.col(f)), lambda t: F.array_contains(wanted, t))).alias("n"), F.lit(-i).alias("at"), F.lit(f).alias("field"), snippet(F.col(f), terms, width).alias("text")) for i, f in enumerate(fields)))
    best = F.array_max(counted)
    return F.when(best["n"] > 0, F.struct(best["field"].alias("field"), best["text"].alias("text")))


def fuzzy_search(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows where every word of the query is near some word of a field."""
    for term in [w for w in re.split(r'[\s"()]+', query.lower()) if w and w not in OPERATORS]:
        hit = F.lit(False)
        for f in fields:
            hit = hit | fuzzy_match(F.col(f), term)
        df = df.filter(hit)
    return df
