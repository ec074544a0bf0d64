"""Markdown chunks, script validation and the two halves of the script job."""

import json
import time
import random

import pytest
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions import script_text as ST
from duebook.operators import retrieval as RT
from duebook.plans import scripts as PS
from duebook.sources import readers as RD

BOOK = """Before any title.

# Playbook
## Reminders
### First
Be kind.

Second paragraph
on two lines.
### Second
```python
# not a header
x = 1

```
After the code.
~~~
``` still inside
## not a header either
~~~
## Empty
## Escalation
Call them.
#### too deep
# Other book
#hashtag
"""


def chunks(spark, text):
    df = spark.createDataFrame([("book.md", text)], "source string, text string")
    return [tuple(r) for r in RT.chunk_by_headers(df).orderBy("chunk_no").select(
        "section_h1", "section_h2", "section_h3", "text").collect()]


def test_chunks(spark):
    got = chunks(spark, BOOK)
    assert got == [
        (None, None, None, "Before any title."),
        ("Playbook", "Reminders", "First",
         "# Playbook  \n## Reminders  \n### First\nBe kind.  \nSecond paragraph\non two lines."),
        ("Playbook", "Reminders", "Second",
         "### Second\n```python\n# not a header\nx = 1\n\n```\nAfter the code.\n~~~\n``` still inside\n## not a header either\n~~~"),
        ("Playbook", "Empty", None, "## Empty"),
        ("Playbook", "Escalation", None, "## Escalation\nCall them.\n#### too deep"),
        ("Other book", None, None, "# Other book\n#hashtag"),
    ]


def test_higher_header_resets_lower(spark):
    got = chunks(spark, "# A\nx\n### C\ny\n## B\nz\n# A2\nw")
    assert [g[:3] for g in got] == [("A", None, None), ("A", None, "C"), ("A", "B", None), ("A2", None, None)]


def test_same_path_stays_together(spark):
    assert chunks(spark, "# A\nx\n# A\ny") == [("A", None, None, "# A\nx  \n# A\ny")]


def test_read_playbook(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\ntext", encoding="utf-8")
    (tmp_path / "a.md").write_text("# A\nä", encoding="utf-8")
    (tmp_path / "c.txt").write_text("no", encoding="utf-8")
    rows = {r["source"]: r["text"] for r in RD.read_playbook(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": "# A\nä", "b.md": "# B\ntext"}
    twin = RD.read_playbook(spark, str(tmp_path)).withColumn("source", F.lit("same"))
    assert RT.chunk_by_headers(twin, key="path").count() == 2
    summary = RT.chunk_summary(RT.chunk_by_headers(RD.read_playbook(spark, str(tmp_path)))).orderBy("source").collect()
    assert [(r["source"], r["chunk"], r["h2"], r["chars"]) for r in summary] == [("a.md", 1, "-", 5), ("b.md", 1, "-", 8)]


GOOD = {"action": "send_email", "stage": "stage_1_friendly", "tone": "friendly", "priority": "low", "subject": "Reminder CUSTOMER_NAME",
        "email_body": "Dear CUSTOMER_NAME", "reasoning": "because of rules", "playbook_reference": "Section 1"}


def failure(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(ST.strip_code_fence(F.col("t")).alias("t"))
    return df.select(ST.script_failure(F.col("t"), ST.parse_script(F.col("t"))).alias("f")).first()["f"]


@pytest.mark.parametrize("change, expected", [
    ({}, None),
    ({"action": "call"}, "Validation failed: Invalid action: call"),
    ({"stage": "stage_9"}, "Validation failed: Invalid stage: stage_9"),
    ({"tone": "angry"}, "Validation failed: Invalid tone: angry"),
    ({"priority": None}, "Validation failed: Invalid priority: None"),
    ({"subject": "  Hi  "}, "Validation failed: Field 'subject' is empty or too short."),
    ({"email_body": 123456}, "Validation failed: Field 'email_body' is empty or too short."),
    ({"action": "no_action", "subject": ""}, None),
    ({"reasoning": "no"}, "Validation failed: Field 'reasoning' is empty or too short."),
    ({"playbook_reference": None}, "Validation failed: Field 'playbook_reference' is empty or too short."),
])
def test_validation(spark, change, expected):
    assert failure(spark, json.dumps({**GOOD, **change})) == expected


def test_unreadable_and_missing(spark):
    assert failure(spark, "I cannot help") == "JSON parse error: not a JSON object"
    assert failure(spark, "[1, 2]") == "JSON parse error: not a JSON object"
    short = {k: v for k, v in GOOD.items() if k not in ("tone", "subject")}
    assert failure(spark, json.dumps(short)) == "Validation failed: Missing keys: tone, subject"


@pytest.mark.parametrize("raw", ["```json\n{x}\n```", "```\n{x}\n```", "  ```json {x}```  ", "{x}", "\n{x}\n"])
def test_fences(spark, raw):
    assert failure(spark, raw.replace("{x}", json.dumps(GOOD))) is None


SCENARIOS = [(1, 28500.0, -7, .12), (2, 47200.0, 5, .42), (3, 82000.0, 15, .75), (4, 9800.0, 3, .33), (5, 54300.0, 30, .68)]


def test_scenarios(spark):
    """Five invoices through both halves of the job: prompts out, outputs back."""
    inv = spark.createDataFrame(
        [(i, f"00{i}", a, p, r, "2020-05-22", "NAA8") for i, a, p, r in SCENARIOS],
        "doc_id long, cust_number string, total_open_amount double, days_past_due int, cust_late_ratio double, due_in_date string, cust_payment_terms string")
    book = spark.createDataFrame([("p.md", BOOK)], "source string, text string")
    cut = RT.chunk_by_headers(book).select(F.xxhash64("source", "chunk_no").alias("id"), "source", "section_h2", "text")
    model = RT.text_model(cut)
    prompts = PS.prepare_prompts(inv, RT.embed_text(model, cut), model, k=2).orderBy("doc_id").collect()
    assert [len(p["retrieved_sections"]) for p in prompts] == [2] * 5
    assert prompts[0]["query"] == ("Invoice upcoming by 7 days. Amount: $28,500. Customer risk: low. "
                                   "What communication action should be taken?")
    assert "Days past due:        15 (overdue)" in prompts[2]["invoice_context"]
    assert "Customer late ratio:  75%" in prompts[2]["invoice_context"]
    assert prompts[0]["context"].endswith("\n\n---\n\n") and prompts[0]["context"].startswith("[p.md — ")

    outputs = [json.dumps(GOOD), "```json\n" + json.dumps(GOOD) + "\n```", "sorry", None, json.dumps({**GOOD, "tone": "x"})]
    raw = spark.createDataFrame([(i, t, f"Customer {i}", p, ["a — b"], "timeout" if t is None else None)
                                 for (i, _, p, _), t in zip(SCENARIOS, outputs)],
                                "doc_id long, raw_text string, name_customer string, days_past_due int, "
                                "retrieved_sections array<string>, error string")
    done = PS.finish_scripts(raw).orderBy("doc_id").collect()
    assert [d["action"] for d in done] == ["send_email", "send_email", "manual_review", "manual_review", "manual_review"]
    assert done[0]["subject"] == "Reminder Customer 1" and done[0]["retrieved_sections"] == ["a — b"]
    assert (done[2]["priority"], done[3]["priority"], done[4]["priority"]) == ("high", "medium", "high")
    assert done[3]["reasoning"] == "Fallback triggered: LLM error: timeout"
    assert done[4]["reasoning"] == "Fallback triggered: Validation failed: Invalid tone: x" and done[4]["retrieved_sections"] == []
    assert PS.fallback_count(PS.finish_scripts(raw)).first()["fallbacks"] == 3
    assert set(done[0].asDict()) == {*schema.SCRIPT_KEYS, "doc_id", "customer_name", "generated_at", "retrieved_sections"}


def toggles_of(lines):
    """Fence by fence: which lines open or close one."""
    inside, out = "", []
    for line in lines:
        opens = "```" if line.startswith("```") and line.count("```") == 1 else "~~~" if line.startswith("~~~") else ""
        if inside:
            closes = line.startswith(inside)
            out.append(int(closes))
            inside = "" if closes else inside
        else:
            out.append(int(bool(opens)))
            inside = opens
    return out


def test_fences_of_long_documents(spark):
    rnd = random.Random(6)
    marks = ["```", "```py", "``` a ``` b", "~~~", "~~~~ x", "text", "# head", "", "``````"]
    documents = [[rnd.choice(marks) for _ in range(n)] for n in (1, 5, 255, 256, 257, 3000)]
    documents += [["```"] * 1000, ["text"] * 600, [""]]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, lines array<string>")
    got = {r["i"]: list(r["t"]) for r in df.select("i", RT._fence_toggles(F.col("lines")).alias("t")).collect()}
    for i, d in enumerate(documents):
        assert got[i] == toggles_of(d)


def test_chunks_of_a_long_document_take_time_in_proportion(spark):
    def seconds(lines):
        text = "\n".join("```" if i % 7 == 0 else f"## head {i}" if i % 50 == 1 else f"line {i}" for i in range(lines))
        book = spark.createDataFrame([("a.md", text)], "source string, text string")
        start = time.time()
        assert RT.chunk_by_headers(book).count() > 10
        return time.time() - start
    seconds(2000)
    assert seconds(200_000) < 30 * max(seconds(20_000), 0.5)


def test_every_text_is_a_file_that_its_task_wrote(spark, tmp_path):
    """Files stay where tasks write them, a folder for each task; no commit moves them, and files of other attempts are not read."""
    from duebook.sources import writers as W
    texts = ["one", "two\nlines", "ä" * 3000, "", None, "one"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b", f"file:{tmp_path}/c d"):
        folders = W.write_texts(frame, folder)
        lost = tmp_path / folder.rsplit("/", 1)[1] / "part-lost"
        lost.mkdir()
        (lost / "0.txt").write_text("of an attempt that failed\n")
        assert sorted(r["text"] for r in RD.read_playbook(spark, folders, "*.txt").collect()) == sorted(f"{t or ''}\n" for t in texts)
        assert len(list(lost.parent.rglob("*"))) == len(folders) + len(texts) + 2
    assert RD.read_playbook(spark, W.write_texts(frame.where("false"), str(tmp_path / "none")), "*.txt").count() == 0
