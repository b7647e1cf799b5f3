"""Personal data: fixed patterns with positions, and terms that give a protected entity away."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import land

# The kinds in their order and what each one matches.  The groups never give characters back (possessive),
# and a look-behind keeps a run from being tried again from each of its letters; neither changes what matches.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BETWEEN = r"[^\p{L}]+"
BORDERS = r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})"
COMMON = 1 << 18    # terms with at least this part of all words, at most so many, are sent to every task


def found(text, pattern: str):
    """All matches with positions as array<struct<s, e, m>>, in code points, end exclusive.

    The pieces between the matches give the positions: a match starts behind all earlier pieces and matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    start = "cast(null as array<struct<s:int,e:int,m:string>>)"
    walk = F.aggregate(
        F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda piece, hit: F.struct(piece.alias("piece"), hit.alias("hit"))),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x["piece"]) + F.length(x["hit"])).alias("at"),
                              F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["piece"])).alias("s"), (a["at"] + F.length(x["piece"]) + F.length(x["hit"])).alias("e"),
                                                                 x["hit"].alias("m")))).alias("out")),
        lambda a: a["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), walk).otherwise(F.expr(start))


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m):
    """Every second digit from the right counts double, less 9 beyond 9; the sum ends in 0."""
    back = F.reverse(_digits(m))
    one = lambda i: F.ascii(F.substring(back, i, F.lit(1))) - 48
    add = lambda acc, i: acc + F.when(i % 2 == 1, one(i)).otherwise(2 * one(i) - F.when(one(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), add) % 10 == 0


def _part_fits(part):
    low = F.regexp_replace(part, "^0+", "")
    return (F.length(low) <= 3) & (F.coalesce(low.try_cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _part_fits),
    "card": lambda m: F.length(_digits(m)).between(13, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
#: A text without this character has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _valid(spans, holds):
    return F.filter(spans, lambda x: holds(x["m"]))


def base_spans(text):
    """Columns n -> array<struct<s, e, m>> of the valid matches per kind."""
    out = {}
    for kind in KINDS:
        spans = _valid(found(text, PATTERNS[kind]), VALID[kind])
        if kind in NEEDS:
            spans = F.when(F.contains(text, F.lit(NEEDS[kind])), spans)
        out[kind] = F.coalesce(spans, F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)"))
    return out


def surely(k, n, z: float):
    """Lower end of Wilson's interval of a share seen as k of n: 1 of 1 proves little, 10 of 10 much."""
    p, zz = k / n, z * z
    return (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def document_terms(words: DataFrame, texts: DataFrame, z: float) -> DataFrame:
    """Every term with the kind it discloses most: term, n_all, kind, disclosure (both null where it stands with no kind).

    ``words`` has a row per text and distinct term, ``texts`` one per text, both with whether the text has a span of each kind.  Counts are
    texts of the whole table, so a text that repeats a word proves nothing more.  With p(kind) the share of all texts, a term's
    information about the kind is log(p(kind | term) / p(kind)), at most the information content -log p(kind) of the entity itself.
    ``disclosure`` is the quotient: 1 means that whoever sees the term knows that an entity was there.  p(kind | term) is taken at the lower
    end of its Wilson interval of ``z`` deviations: terms of few texts are rated, by what their few texts prove.  A kind that every text has
    is disclosed by none.
    """
    seen = [F.count_if(F.col(f"has_{k}")).alias(f"n_{k}") for k in KINDS]
    counted = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_all"), *seen)
    total = texts.agg(F.count(F.lit(1)).alias("texts"), *[F.count_if(F.col(f"has_{k}")).alias(k) for k in KINDS]).first()
    rates = {k: total[k] / total["texts"] for k in KINDS if total[k] and total[k] < total["texts"]}
    share = lambda k: surely(F.col(f"n_{k}").cast("double"), F.col("n_all").cast("double"), z)
    rated = [F.when(F.col(f"n_{k}") > 0, F.struct((F.log(share(k) / F.lit(rates[k])) / F.lit(-math.log(rates[k]))).alias("disclosure"), F.lit(k).alias("kind"))) for k in rates]
    best = F.array_max(F.array(*rated, F.lit(None).cast("struct<disclosure:double,kind:string>")))
    return counted.select("term", "n_all", best.alias("best")).select("term", "n_all", "best.kind", "best.disclosure")


def _placed(text, terms):
    """Where the given terms (array<struct<term, kind, action>>) stand in a text, found by a walk over its runs of letters and others."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,term:string,kind:string,action:string>>)")
    names = F.transform(terms, lambda t: t["term"])

    def step(a, piece):
        end = (a["at"] + F.length(piece)).cast("int")
        spot = F.array_position(names, F.lower(piece)).cast("int")
        hit = F.get(terms, spot - 1)
        return F.struct(end.alias("at"), F.when(spot > 0, F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), end.alias("e"), hit["term"].alias("term"), hit["kind"].alias("kind"), hit["action"].alias("action"))))).otherwise(a["out"]).alias("out"))
    return F.aggregate(F.split(text, BORDERS), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", generalise: float = 0.75, remove: float = 0.95, z: float = 1.96, everywhere: bool = False,
                  keep_text: bool = False, broadcast_rows: int = 500_000) -> DataFrame:
    """Spans of personal data and of the terms that disclose it, per row: key, ``email``, ``ip``, ``card``, ``phone``
    (array<struct<s, e, m>>) and ``terms`` (array<struct<s, e, term, kind, action>>, by start); ``text`` on request.

    Every word of a text that has a base span is rated, wherever in the text it stands (see ``document_terms``).  Terms whose
    disclosure of a kind reaches ``remove`` are to be removed, those that reach ``generalise`` to be replaced by the name of the
    kind: all their occurrences outside base spans, with ``everywhere`` in all texts, else in those with a base span.  All
    counts cover the whole table.  Texts are written once, and moved once unless the disclosing terms' rows are few enough to be broadcast; a text's words never
    become rows with positions.

    A null text is empty; empty texts have no spans.  A term that discloses several kinds is reported with the one it discloses
    most.  Words are runs of letters, compared in lower case.  Up to ``broadcast_rows`` disclosing terms are sent to every task,
    more are joined by a shuffle, with the same result.  Repeated rows are treated row by row; null keys are kept.  An
    empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select(F.col(key).alias("_key"), body.alias("_text"), *[c.alias(k) for k, c in base_spans(body).items()])
    marked = land(raw.withColumn("_row", F.monotonically_increasing_id()), "pii-spans")

    # of the base spans, only addresses hold letters
    outside = F.when(F.contains("_text", F.lit("@")), F.regexp_replace("_text", PATTERNS["email"], " ")).otherwise(F.col("_text"))
    has = [(F.size(k) > 0).alias(f"has_{k}") for k in KINDS]
    every_word = F.array_distinct(F.transform(F.split(outside, BETWEEN), F.lower))
    words = marked.select("_row", *has, F.explode(every_word).alias("term")).where("term <> ''")
    rated = land(document_terms(words, marked.select(*has), z), "pii-rated")
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    level = rated.where(F.col("disclosure") >= generalise).select("term", "kind", action.alias("action"))

    looked_at = words if everywhere else words.where(" OR ".join(f"has_{k}" for k in KINDS))
    looked_at = looked_at.select("_row", "term")
    if level.count() <= broadcast_rows:
        level = F.broadcast(level)
    else:  # only what may be such a term is moved
        many = rated.agg(F.sum("n_all")).first()[0] / COMMON
        plain = rated.where((F.col("n_all") >= many) & ~F.coalesce(F.col("disclosure") >= generalise, F.lit(False))).select("term")
        looked_at = looked_at.join(F.broadcast(plain), "term", "left_anti")
    hits = looked_at.join(level, "term").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("term", "kind", "action"))).alias("hit_terms"))
    hits = land(hits, "pii-hits")

    found_terms = marked.select("_row", "_text", "email").join(hits, "_row").select("_row", "email", _placed(F.col("_text"), F.col("hit_terms")).alias("all_terms"))
    clear = F.filter("all_terms", lambda w: ~F.exists("email", lambda b: (b["s"] < w["e"]) & (b["e"] > w["s"])))
    out = marked.select("_row", "_key", *KINDS, *(["_text"] if keep_text else [])).join(found_terms.select("_row", clear.alias("terms")), "_row", "left")
    none = F.expr("cast(array() as array<struct<s:int,e:int,term:string,kind:string,action:string>>)")
    kept = [F.col("_text").alias("text")] if keep_text else []
    return out.select(F.col("_key").alias(key), *KINDS, F.coalesce("terms", none).alias("terms"), *kept)


def span_list(kinds=(*KINDS, "term")):
    """``kind:start:end`` of the named kinds in their order, then by start, comma-joined."""
    one = lambda k: F.transform(F.col("terms" if k == "term" else k), lambda x: F.concat(F.lit(k + ":"), x["s"], F.lit(":"), x["e"]))
    return F.array_join(F.concat(*[one(k) for k in kinds]), ",")


def sanitised(found_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts with base spans replaced by their kind, disclosing terms generalised or removed: key, ``text``.

    ``found_rows`` comes from ``personal_data(..., keep_text=True)``.  Where spans overlap, the one that starts first counts and
    the later one's rest is cut off with it.
    """
    named = lambda k: F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{k.upper()}]").alias("by")))
    base = [named(k) for k in KINDS]
    terms = F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["action"] == "remove", "").otherwise(F.concat(F.lit("["), x["kind"], F.lit("]"))).alias("by")))
    edits = F.array_sort(F.concat(*base, terms))
    step = lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], F.concat(a["out"], F.substring("text", a["at"] + 1, x["s"] - a["at"]), x["by"])).otherwise(a["out"]).alias("out"))
    done = F.aggregate(edits, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    return found_rows.select(key, done.alias("text"))
