"""Collections scripts: context, retrieval, validation, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duebook.catalog.base import AS_OF, PARTS, plain, query, r, sql
from duebook.functions import script_text as ST
from duebook.operators import retrieval as RT
from duebook.plans import scripts as PS
from duebook.sources import adapter as A

PAST = f"CAST({AS_OF} - due_in_date AS INTEGER)"
RATIO = "CAST(doc_id * 7 % 101 AS DOUBLE) / 100"
TIER = f"CASE WHEN {RATIO} < 0.2e0 THEN 'low' WHEN {RATIO} < 0.6e0 THEN 'medium' ELSE 'high' END"
PCT = f"CAST(CAST(round_even({RATIO} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


def requests(spark, d, with_name=True):
    inv = A.invoices(spark, d, only_paid=False, with_name=with_name)
    return (inv.withColumn("days_past_due", F.datediff(A.as_of(), "due_in_date"))
            .withColumn("cust_late_ratio", (F.col("doc_id") * 7 % 101).cast("double") / 100))


LINES = [("Invoice ID:", "CAST(doc_id AS VARCHAR)"), ("Customer name:", "'CUSTOMER_NAME'"), ("Customer number:", "cust_number"),
         ("Amount due:", "'$' || format('{:,.2f}', total_open_amount) || ' ' || trim(invoice_currency)"),
         ("Due date:", "CAST(due_in_date AS VARCHAR)"),
         ("Days past due:", f"{PAST} || ' (' || CASE WHEN {PAST} > 0 THEN 'overdue' ELSE 'not yet due' END || ')'"),
         ("Business segment:", "'Unknown'"), ("Payment terms:", "cust_payment_terms"), ("Predicted is_late:", "'Unknown'"),
         ("Predicted days late:", "'Unknown'"), ("Customer late ratio:", PCT), ("Customer risk tier:", TIER),
         ("Customer risk score:", "'Unknown'"), ("N previous invoices:", "'Unknown'")]


@query("invoice_context", sql("inv", "SELECT doc_id, " + " || chr(10) || ".join(
    f"'{label.ljust(22)}' || {value}" for label, value in LINES) + " AS invoice_context FROM inv"))
def _(spark, d):
    inv = requests(spark, d, with_name=False)
    text = ST.invoice_context(doc_id=F.col("doc_id"), cust_number=F.col("cust_number"), amount=F.col("total_open_amount"),
                              due=F.col("due_in_date"), past_due=F.col("days_past_due"), currency=F.trim("invoice_currency"),
                              terms=F.col("cust_payment_terms"), late_ratio=F.col("cust_late_ratio"))
    return inv.select("doc_id", text.alias("invoice_context"))


QUESTION = f"""'Invoice ' || CASE WHEN {PAST} > 0 THEN 'overdue' ELSE 'upcoming' END || ' by ' || abs({PAST}) || ' days. Amount: $'
  || format('{{:,.0f}}', total_open_amount) || '. Customer risk: ' || {TIER} || '. What communication action should be taken?'"""


@query("retrieval_query", sql("inv", f"SELECT doc_id, {QUESTION} AS query FROM inv"))
def _(spark, d):
    text = ST.retrieval_query(F.col("days_past_due"), F.col("total_open_amount"), F.col("cust_late_ratio"))
    return requests(spark, d, with_name=False).select("doc_id", text.alias("query"))


# -- raw outputs: valid, fenced, broken, a key missing, a bad value, a short subject ------------------------

GOOD = ('{{"action": "send_email", "stage": "stage_4_first_overdue", "tone": "neutral", "priority": "medium", '
        '"subject": "Invoice {id} for CUSTOMER_NAME", "email_body": "Dear CUSTOMER_NAME, please pay {id}.", '
        '"reasoning": "Overdue by some days", "playbook_reference": "Reminders"}}')


def raw_outputs(spark, d):
    base = requests(spark, d)
    good = F.concat(*[F.col("doc_id").cast("string") if part == "{id}" else F.lit(part) for part in _parts()])
    kind = F.col("doc_id") % 6
    text = (F.when(kind == 0, good).when(kind == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
            .when(kind == 2, F.regexp_replace(good, "}$", "")).when(kind == 3, F.replace(good, F.lit('"tone": "neutral", '), F.lit("")))
            .when(kind == 4, F.replace(good, F.lit('"send_email"'), F.lit('"send_mail"')))
            .otherwise(F.replace(good, F.concat(F.lit("Invoice "), F.col("doc_id").cast("string"), F.lit(" for CUSTOMER_NAME")), F.lit("Hi"))))
    return base.withColumn("raw_text", text)


def _parts() -> list[str]:
    """The valid script cut at the places where the invoice id goes."""
    out: list[str] = []
    for i, piece in enumerate(GOOD.replace("{{", "{").replace("}}", "}").split("{id}")):
        out += ([] if i == 0 else ["{id}"]) + [piece]
    return out


VALID = "(doc_id % 6 <= 1)"
REASON = """CASE doc_id % 6 WHEN 2 THEN 'JSON parse error: not a JSON object' WHEN 3 THEN 'Validation failed: Missing keys: tone'
  WHEN 4 THEN 'Validation failed: Invalid action: send_mail' WHEN 5 THEN 'Validation failed: Field ''subject'' is empty or too short.' END"""
PARTS["scripts"] = (["named"], f"""
  SELECT *, {PAST} AS days_past_due, {RATIO} AS ratio, {PCT} AS pct, CASE WHEN {VALID} THEN 'send_email' ELSE 'manual_review' END AS action,
    CASE WHEN {VALID} THEN 'stage_4_first_overdue' ELSE 'none' END AS stage, 'neutral' AS tone,
    CASE WHEN {VALID} THEN 'medium' WHEN {PAST} > 10 THEN 'high' ELSE 'medium' END AS priority,
    CASE WHEN {VALID} THEN 'Invoice ' || doc_id || ' for ' || name_customer ELSE 'Manual review required — Invoice ' || doc_id END AS subject,
    CASE WHEN {VALID} THEN 'Dear ' || name_customer || ', please pay ' || doc_id || '.' ELSE 'Please review this invoice manually.' END AS email_body,
    CASE WHEN {VALID} THEN 'Overdue by some days' ELSE 'Fallback triggered: ' || {REASON} END AS reasoning,
    CASE WHEN {VALID} THEN 'Reminders' ELSE 'N/A — fallback' END AS playbook_reference FROM named""")


@query("strip_code_fence", sql("named", """
  SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 0 ELSE 1 END AS unchanged, 0 AS has_fence FROM named"""))
def _(spark, d):
    out = raw_outputs(spark, d)
    text = ST.strip_code_fence(F.col("raw_text"))
    return out.select("doc_id", (text == F.col("raw_text")).cast("int").alias("unchanged"),
                      F.contains(text, F.lit("```")).cast("int").alias("has_fence"))


@query("parse_script_json", sql("scripts", """
  SELECT doc_id, CAST(doc_id % 6 <> 2 AS INTEGER) AS readable, CASE doc_id % 6 WHEN 2 THEN NULL WHEN 5 THEN 'Hi'
    ELSE 'Invoice ' || doc_id || ' for CUSTOMER_NAME' END AS subject FROM scripts"""))
def _(spark, d):
    text = ST.strip_code_fence(F.col("raw_text"))
    out = raw_outputs(spark, d).select("doc_id", text.alias("t"))
    ok = ST.is_json_object(F.col("t"))
    return out.select("doc_id", ok.cast("int").alias("readable"), F.when(ok, ST.parse_script(F.col("t"))["subject"]).alias("subject"))


@query("validate_script", sql("scripts", f"SELECT doc_id, {REASON} AS failure FROM scripts"))
def _(spark, d):
    out = raw_outputs(spark, d).withColumn("t", ST.strip_code_fence(F.col("raw_text")))
    return out.select("doc_id", ST.script_failure(F.col("t"), ST.parse_script(F.col("t"))).alias("failure"))


@query("fallback_script", sql("inv", f"""
  SELECT doc_id, 'manual_review' AS action, 'none' AS stage, 'neutral' AS tone, CASE WHEN {PAST} > 10 THEN 'high' ELSE 'medium' END AS priority,
    'Manual review required — Invoice ' || doc_id AS subject, 'Please review this invoice manually.' AS email_body,
    'Fallback triggered: test' AS reasoning, 'N/A — fallback' AS playbook_reference FROM inv"""))
def _(spark, d):
    script = ST.fallback_script(F.col("doc_id"), F.col("days_past_due"), F.lit("test"))
    return requests(spark, d, with_name=False).select("doc_id", script.alias("s")).select("doc_id", "s.*")


FINAL = "action, stage, tone, priority, subject, email_body, reasoning, playbook_reference, doc_id, name_customer AS customer_name"


def finished(spark, d):
    return PS.finish_scripts(raw_outputs(spark, d)).drop("generated_at", "retrieved_sections")


@query("finish_scripts", sql("scripts", f"SELECT {FINAL} FROM scripts"))
def _(spark, d):
    return finished(spark, d)


@query("restore_placeholder", sql("named", "SELECT doc_id, 'Dear ' || name_customer || ', ' || name_customer || ' owes.' AS body FROM named"))
def _(spark, d):
    text = F.lit("Dear CUSTOMER_NAME, CUSTOMER_NAME owes.")
    return requests(spark, d).select("doc_id", ST.restore_name(text, F.col("name_customer")).alias("body"))


@query("fix_body", sql("inv", "SELECT doc_id, 'Invoice ' || doc_id || ' was due ' || CAST(due_in_date AS VARCHAR) || '.' AS body FROM inv"))
def _(spark, d):
    raw = A.raw_invoices(spark, d)
    raw_id, raw_date = F.concat(F.col("doc_id").cast("string"), F.lit(".0")), F.col("due_in_date").cast("bigint").cast("string")
    text = F.concat(F.lit("Invoice "), raw_id, F.lit(" was due "), raw_date, F.lit("."))
    return raw.select("doc_id", ST.fix_body(text, raw_id, raw_date).alias("body"))


@query("script_summary", sql("scripts", """
  SELECT doc_id AS invoice, name_customer AS customer, days_past_due, '$' || format('{:,.0f}', total_open_amount) AS amount, pct AS late_ratio,
    action, stage, tone, priority FROM scripts"""))
def _(spark, d):
    return PS.script_summary(finished(spark, d), requests(spark, d, with_name=False))


@query("fallback_count", sql("scripts", f"SELECT count(*) AS scripts, count(*) FILTER (WHERE NOT {VALID}) AS fallbacks FROM scripts"))
def _(spark, d):
    return PS.fallback_count(finished(spark, d))


# -- retrieval -------------------------------------------------------------------------------------------

DISTANCE = "list_sum(list_transform(list_zip(q.embedding, s.embedding), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2)))"


def knn_sql(condition: str) -> str:
    return f"""SELECT query_id, id, rank, {r('distance')} AS distance FROM (
      SELECT query_id, id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM (
        SELECT q.vec_id AS query_id, s.vec_id AS id, {DISTANCE} AS distance FROM embeddings q JOIN embeddings s ON {condition})) WHERE rank <= 4"""


def vectors(spark, d):
    e = A.table(spark, d, "embeddings")
    return (e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label"),
            e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"))


@query("knn_join", knn_sql("true"))
def _(spark, d):
    q, s = vectors(spark, d)
    return plain(RT.knn_join(q, s))


@query("knn_join_cells", knn_sql("true"))
def _(spark, d):
    """The same by two levels of cells and a second round for the queries whose neighbours may lie in other cells."""
    q, s = vectors(spark, d)
    return plain(RT.knn_join(q, s, fan=4))


@query("knn_join_filtered", knn_sql("q.label = s.label"))
def _(spark, d):
    q, s = vectors(spark, d)
    return plain(RT.knn_join(q, s, by="label"))


NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query("knn_join_cosine", f"""
  WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS v FROM (SELECT *, {NORM} AS n FROM embeddings))
  SELECT query_id, id, rank, {r('distance')} AS distance FROM (
    SELECT query_id, id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS id,
        list_sum(list_transform(list_zip(a.v, b.v), lambda x: pow(x[1] - x[2], 2))) AS distance FROM u a CROSS JOIN u b)) WHERE rank <= 4""")
def _(spark, d):
    q, s = vectors(spark, d)
    return plain(RT.knn_join(RT.unit_vectors(q), RT.unit_vectors(s)))


def playbook(spark, d):
    """Every document as Markdown: a title, a fenced block, a section with the whole text."""
    docs = A.table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.concat(
        F.lit("# "), F.col("source"), F.lit("\n\n```\n# no header\n```\n## "), F.col("lang"), F.lit("\n"), F.col("text")).alias("text"))


CHUNKS = """WITH lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  kept AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS line,
    lag(trim(line, ' ' || chr(9) || chr(13))) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM lines),
  body AS (SELECT doc_id, string_agg(CASE WHEN prev = '' THEN '  ' ELSE '' END || chr(10) || line, '' ORDER BY pos) AS t
    FROM kept WHERE line <> '' GROUP BY 1),
  chunks AS (SELECT CAST(doc_id AS VARCHAR) AS source, 1 AS chunk_no, source AS section_h1, NULL AS section_h2,
      '# ' || source || '  ' || chr(10) || '```' || chr(10) || '# no header' || chr(10) || '```' AS text FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 2, source, lang, '## ' || lang || coalesce(t, '') FROM documents LEFT JOIN body USING (doc_id))"""


@query("chunk_by_headers", CHUNKS + " SELECT source, chunk_no, section_h1, section_h2, md5(text) AS digest FROM chunks")
def _(spark, d):
    chunks = RT.chunk_by_headers(playbook(spark, d))
    return chunks.select("source", "chunk_no", "section_h1", "section_h2", F.md5("text").alias("digest"))


@query("chunk_summary", CHUNKS + " SELECT source, chunk_no AS chunk, coalesce(section_h2, '-') AS h2, '-' AS h3, CAST(length(text) AS INTEGER) AS chars FROM chunks")
def _(spark, d):
    return RT.chunk_summary(RT.chunk_by_headers(playbook(spark, d)))


HITS = """WITH h AS (SELECT doc_id // 4 AS query_id, CAST(doc_id % 4 + 1 AS INTEGER) AS rank, source, lang, text FROM documents)"""


def hits(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select(F.expr("doc_id div 4").alias("query_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("rank"),
                       "source", F.col("lang").alias("section_h2"), "text")


@query("build_context", HITS + """ SELECT query_id, md5(string_agg('[' || source || ' — ' || lang || ']' || chr(10) || text || chr(10) || chr(10) || '---'
  || chr(10) || chr(10), '' ORDER BY rank)) AS digest, string_agg(source || ' — ' || lang, '|' ORDER BY rank) AS sections FROM h GROUP BY 1""")
def _(spark, d):
    c = RT.build_context(hits(spark, d))
    return c.select("query_id", F.md5("context").alias("digest"), F.array_join("retrieved_sections", "|").alias("sections"))


@query("section_usage", HITS + " SELECT source || ' — ' || lang AS section, count(*) AS n FROM h GROUP BY 1")
def _(spark, d):
    return RT.section_usage(RT.build_context(hits(spark, d)))


@query("embed_text", """
  SELECT doc_id, 256 AS size, CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]') THEN 1.0e0 ELSE 0.0e0 END AS norm FROM documents""")
def _(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    embedded = RT.embed_text(RT.text_model(docs), docs)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return plain(embedded.select("doc_id", F.size("vector").alias("size"), norm.alias("norm")))


def prompts(spark, d):
    docs = A.table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("section_h2"), "text")
    model = RT.text_model(chunks)
    return PS.prepare_prompts(requests(spark, d, with_name=False), RT.embed_text(model, chunks), model)


@query("prepare_prompts_question", sql("inv", f"SELECT doc_id, {QUESTION} AS query, " + " || chr(10) || ".join(
    f"'{label.ljust(22)}' || {value}" for label, value in LINES) + " AS invoice_context, 4 AS sections FROM inv"))
def _(spark, d):
    """What of the prompts SQL can state: question, invoice block and number of retrieved chunks."""
    return prompts(spark, d).select("doc_id", "query", "invoice_context", F.size("retrieved_sections").alias("sections"))


@query("prepare_prompts")
def _(spark, d):
    return plain(prompts(spark, d).select("doc_id", "query", "invoice_context", F.length("context").alias("context_chars"), "retrieved_sections"))
