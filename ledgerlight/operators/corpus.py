"""Texts for retrieval: cleaning, documents, and chunks with their offsets.

Chunking is greedy and sequential within a document: a fold over its text in built-in
expressions, where it is read; documents are independent, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerlight.functions import text as T

# Boundaries of chunks (each with the first character behind it), and elements whose text is not read.
PARAGRAPH = r"\n[ \t]*\n+[^\n]"
SENTENCE = r"[.!?][\"\x27)\]]*[ \t\n]+[^ \t\n]"
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = rf"[{_SPACE}]+[^{_SPACE}]"
HIDDEN = ("script", "style", "noscript", "head", "template", "ix:header", "ix:hidden")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self._hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in self._hidden:
            while self._hidden and self._hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self._hidden and (piece := data.strip()):
            self.parts.append(piece)


def in_slices(values: pa.Array, one: Callable, made: pa.DataType, rows: int = 64) -> pa.Array:
    """``one`` of every value (None stays None) as an Arrow array of type ``made``; only a few rows at a time are Python objects."""
    parts = [pa.array([None if v is None else one(v) for v in values.slice(at, rows).to_pylist()], made) for at in range(0, len(values), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], made)


@F.arrow_udf(StringType())
def visible_text(html: pa.Array) -> pa.Array:
    """Visible text of HTML, pieces joined by one space, white space collapsed; null for null."""

    def one(source):
        parser = _Visible()
        parser.feed(source)
        parser.close()
        return " ".join(" ".join(parser.parts).split())

    return in_slices(html, one, pa.string())


def article_text(content: Column, summary: Column) -> Column:
    """Visible content, else visible summary; null if both are blank."""
    return F.coalesce(F.nullif(visible_text(content), F.lit("")), F.nullif(visible_text(summary), F.lit("")))


def documents(rows: DataFrame, *, id_prefix: str, key: str, text: str, version_fields: list[str], cleaning: str = "text-v1") -> DataFrame:
    """Adds document_id, document_text, its hash and document_version_id; rows without text are left out."""
    body = T.collapse(F.col(text))
    kept = rows.withColumn("document_text", F.nullif(body, F.lit(""))).filter("document_text is not null")
    kept = kept.withColumn("document_id", F.concat_ws(":", F.lit(id_prefix), F.col(key).cast("string"))).withColumn("document_text_sha256", T.sha256(F.col("document_text")))
    identity = {"cleaning": F.lit(cleaning), "document_id": F.col("document_id"), "sha256": F.col("document_text_sha256"), **{f: F.col(f).cast("string") for f in version_fields}}
    return kept.withColumn("document_version_id", T.content_id(**identity))


def news_documents(articles: DataFrame) -> DataFrame:
    """Research documents of articles (article_id, headline, content, summary, created_at, ...): id, title, evidence date; those without text are left out."""
    rows = articles.withColumn("document_text", article_text(F.col("content"), F.col("summary"))).filter("document_text is not null")
    return rows.withColumns({"document_id": F.concat_ws(":", F.lit("alpaca:news"), F.col("article_id").cast("string")), "title": F.col("headline"), "evidence_date": F.to_date("created_at"), "source_type": F.lit("news"), "text_origin": F.when(F.nullif(visible_text(F.col("content")), F.lit("")).isNull(), "summary").otherwise("content")})


def all_documents(*parts: DataFrame) -> DataFrame:
    """Documents of several sources as one table; what a source has no column for is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` is ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chunk_spans(text: str, target: int = 2400, most: int = 3200, overlap: int = 300) -> Column:
    """Chunks of a text (SQL): array of character_start, character_end, chunk_text.

    From where a chunk starts its end is, of what there is: the first paragraph's end
    from ``target`` on, the first sentence's, the last paragraph's before it, the last
    sentence's, the last blank's, or ``most`` characters. The next one starts at the
    first boundary in the last ``overlap`` characters. The fold looks at a stretch of
    the text around the chunk only, so it is linear in the text.
    """
    slab = max(1 << 15, 2 * most + 2)
    first = lambda region, p: f"length(regexp_extract({region}, r'(?s)^.*?{p}', 0))"
    # Breaks of paragraphs are told from left to right, each behind the one before; other boundaries end at one place only.
    last = lambda region, p: f"length(regexp_extract({region}, r'(?s)^{f'(?:.*?{p[:-5]})+{p[-5:]}' if p == PARAGRAPH else '.*' + p}', 0))"
    at = lambda base, n: f"if({n} > 0, {base} + {n} - 1, null)"
    # Places are counted from the stretch's own start.
    near, ahead, wide = f"substring(w, s + 1, {target + 1})", f"substring(w, s + {target} + 1, {most - target + 1})", f"substring(w, s + 1, {most + 1})"
    ends = [at(f"s + {target}", first(ahead, p)) for p in (PARAGRAPH, SENTENCE)] + [at("s", last(r, p)) for r, p in ((near, PARAGRAPH), (near, SENTENCE), (wide, BLANK))]
    tail = "substring(w, back + 1, e - back)"
    starts = [at("back", first(tail, p)) for p in (PARAGRAPH, SENTENCE, BLANK)] if overlap else []
    back = f"greatest(s + 1, e - {overlap})" if overlap else "e"
    span = lambda a, b: f"concat(t.spans, array(named_struct('a', {a}, 'b', {b})))"
    go_on = _let("e", f"coalesce({', '.join(ends)}, s + {most})", _let("back", back, f"named_struct('s', base + coalesce({', '.join([*starts, 'back'])}), 'done', false, 'spans', {span('t.s', 'base + e')})"))
    stop = f"named_struct('s', t.s, 'done', true, 'spans', {span('t.s', 'n')})"
    stretch = lambda place, body: _let("base", f"cast(({place} div {slab}) * {slab} as int)", _let("w", f"concat(get(slabs, base div {slab}), coalesce(get(slabs, base div {slab} + 1), ''))", body))
    step = f"if(n - t.s <= {most}, {stop}, {stretch('t.s', _let('s', 't.s - base', go_on))})"
    fold = lambda start, steps: f"aggregate(sequence(1, {steps}), {start}, (t, i) -> if(t.done, t, {step}))"
    # A step costs what has been found: few are tried at first, and more only for a text of very short chunks.
    begin = "named_struct('s', 0, 'done', false, 'spans', cast(array() as array<struct<a: int, b: int>>))"
    whole = _let("r", fold(begin, f"cast(ceil(n / {target - overlap}D) as int) + 8"), f"if(r.done, r.spans, {fold('r', f'greatest(1, n - {most} + 1)')}.spans)")
    text_of = stretch("p.a", "named_struct('character_start', cast(p.a as bigint), 'character_end', cast(p.b as bigint), 'chunk_text', substring(w, p.a - base + 1, p.b - p.a))")
    cut = _let("n", f"length({text})", _let("slabs", f"regexp_extract_all({text}, r'(?s).{{1,{slab}}}', 0)", f"transform({whole}, p -> {text_of})"))
    return F.expr(f"if({text} is null or {text} = '', cast(array() as array<struct<character_start: bigint, character_end: bigint, chunk_text: string>>), {cut})")


def chunks(docs: DataFrame, *, id_col: str = "document_version_id", text_col: str = "document_text", target: int = 2400, most: int = 3200, overlap: int = 300) -> DataFrame:
    """One row per chunk: id, chunk_index, character_start, character_end, chunk_text, its hash, chunk_id. Empty texts have none."""
    if not 0 <= overlap < target <= most:
        raise ValueError("overlap < target <= most")
    cut = docs.select(id_col, F.posexplode(chunk_spans(f"`{text_col}`", target, most, overlap)).alias("chunk_index", "span")).select(id_col, "chunk_index", "span.*")
    cut = cut.withColumn("chunk_text_sha256", T.sha256(F.col("chunk_text")))
    strategy = F.lit(f"greedy-{target}-{most}-{overlap}")
    return cut.withColumn("chunk_id", T.content_id(document=F.col(id_col).cast("string"), strategy=strategy, start=F.col("character_start"), end=F.col("character_end"), sha256=F.col("chunk_text_sha256")))


def chunk_faults(chunk_rows: DataFrame, docs: DataFrame, *, id_col: str = "document_version_id", text_col: str = "document_text") -> DataFrame:
    """Per document: chunks, and whether indexes, coverage and slices are sound."""
    order = Window.partitionBy(id_col).orderBy("chunk_index")
    rows = chunk_rows.join(docs.select(id_col, text_col), id_col)
    gap = F.col("character_start") > F.coalesce(F.lag("character_end").over(order), F.lit(0))
    sliced = F.col("chunk_text") == T.slice_chars(F.col(text_col), F.col("character_start"), F.col("character_end"))
    rows = rows.withColumn("gap", gap).withColumn("off", F.col("chunk_index") != F.row_number().over(order) - 1)
    return rows.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("off").alias("index_faults"),
        F.count_if("gap").alias("gaps"),
        F.count_if(~sliced).alias("slice_faults"),
        (F.max("character_end") != F.max(F.length(text_col))).alias("uncovered"),
    )
