"""Text of a collections script: request context, raw output, validation, fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook import schema
from duebook.functions.risk import customer_tier, format_date, format_id, percent_text

FENCE = "```"


def dollars(amount: Column, digits: int) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, digits))


def _text(column: Column | None, default: str) -> Column:
    return F.lit(default) if column is None else F.coalesce(column.cast("string"), F.lit(default))


def invoice_context(*, doc_id: Column, cust_number: Column, amount: Column, due: Column,
                    past_due: Column, currency: Column | None = None, segment: Column | None = None,
                    terms: Column | None = None, predicted_late: Column | None = None,
                    predicted_days: Column | None = None, late_ratio: Column | None = None,
                    risk: Column | None = None, transactions: Column | None = None) -> Column:
    """The invoice as a block of labelled lines; the customer's name stays masked."""
    ratio = F.lit(0.5) if late_ratio is None else F.coalesce(late_ratio, F.lit(0.5))
    overdue = F.when(past_due > 0, "overdue").otherwise("not yet due")
    lines = [
        ("Invoice ID:", doc_id.cast("string")),
        ("Customer name:", F.lit(schema.NAME_MASK)),
        ("Customer number:", cust_number),
        ("Amount due:", F.concat(dollars(amount, 2), F.lit(" "), _text(currency, "USD"))),
        ("Due date:", due.cast("string")),
        ("Days past due:", F.concat(past_due.cast("string"), F.lit(" ("), overdue, F.lit(")"))),
        ("Business segment:", _text(segment, "Unknown")),
        ("Payment terms:", _text(terms, "Unknown")),
        ("Predicted is_late:", _text(predicted_late, "Unknown")),
        ("Predicted days late:", _text(predicted_days, "Unknown")),
        ("Customer late ratio:", percent_text(ratio)),
        ("Customer risk tier:", customer_tier(ratio)),
        ("Customer risk score:", _text(risk, "Unknown")),
        ("N previous invoices:", _text(transactions, "Unknown")),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(label.ljust(22)), value) for label, value in lines])


def retrieval_query(past_due: Column, amount: Column, late_ratio: Column) -> Column:
    """One sentence that describes the invoice for the playbook search."""
    status = F.when(past_due > 0, "overdue").otherwise("upcoming")
    return F.concat(
        F.lit("Invoice "), status, F.lit(" by "), F.abs(past_due).cast("string"), F.lit(" days. Amount: "),
        dollars(F.rint(amount), 0), F.lit(". Customer risk: "),
        customer_tier(F.coalesce(late_ratio, F.lit(0.5))),
        F.lit(". What communication action should be taken?"),
    )


def strip_code_fence(raw: Column) -> Column:
    """Remove a Markdown code fence around the text; text without a leading fence is only trimmed."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    opened = F.regexp_replace(text, r"(?m)^```(?:json)?\s*", "")
    closed = F.regexp_replace(opened, r"(?m)\s*```$", "")
    return F.when(F.startswith(text, F.lit(FENCE)), F.regexp_replace(closed, r"^\s+|\s+$", "")).otherwise(text)


def is_json_object(text: Column) -> Column:
    return F.json_object_keys(text).isNotNull()


def parse_script(text: Column) -> Column:
    return F.from_json(text, schema.SCRIPT_OUTPUT)


def missing_keys(text: Column) -> Column:
    wanted = F.array(*[F.lit(k) for k in schema.SCRIPT_KEYS])
    return F.array_except(wanted, F.json_object_keys(text))


def _too_short(document: Column, name: str) -> Column:
    """True unless the field is a JSON string of at least five characters."""
    field = F.try_variant_get(document, f"$.{name}", "variant")
    value = F.regexp_replace(F.try_variant_get(field, "$", "string"), r"^\s+|\s+$", "")
    return ~F.coalesce((F.schema_of_variant(field) == "STRING") & (F.length(value) >= 5), F.lit(False))


def validation_error(text: Column, script: Column, document: Column | None = None) -> Column:
    """The first rule the script breaks as text, or null for a valid script.

    ``document`` is the text parsed as a variant, where the caller has it already.
    """
    document = F.try_parse_json(text) if document is None else document
    missing = missing_keys(text)
    enums = [("action", schema.SCRIPT_ACTIONS), ("stage", schema.SCRIPT_STAGES),
             ("tone", schema.SCRIPT_TONES), ("priority", schema.SCRIPT_PRIORITIES)]
    rules = [F.when(F.size(missing) > 0, F.concat(F.lit("Missing keys: "), F.array_join(missing, ", ")))]
    for name, allowed in enums:
        value = script.getField(name)
        rules.append(F.when(~F.coalesce(value.isin(allowed), F.lit(False)),
                            F.concat(F.lit(f"Invalid {name}: "), F.coalesce(value, F.lit("None")))))
    for name in ("subject", "email_body"):
        rules.append(F.when((script.getField("action") == "send_email") & _too_short(document, name),
                            F.lit(f"Field '{name}' is empty or too short.")))
    for name in ("reasoning", "playbook_reference"):
        rules.append(F.when(_too_short(document, name), F.lit(f"Field '{name}' is empty or too short.")))
    return F.coalesce(*rules)


def script_failure(text: Column, script: Column, document: Column | None = None) -> Column:
    """Reason for manual review, or null: unreadable JSON first, then the validation rules."""
    return F.when(~is_json_object(text), F.lit("JSON parse error: not a JSON object")).otherwise(
        F.concat(F.lit("Validation failed: "), validation_error(text, script, document)))


def fallback_script(doc_id: Column, past_due: Column, reason: Column) -> Column:
    """The manual-review record that replaces an unusable script."""
    urgent = F.coalesce(past_due, F.lit(0)) > 10
    return F.struct(
        F.lit("manual_review").alias("action"),
        F.lit("none").alias("stage"),
        F.lit("neutral").alias("tone"),
        F.when(urgent, "high").otherwise("medium").alias("priority"),
        F.concat(F.lit("Manual review required — Invoice "), doc_id.cast("string")).alias("subject"),
        F.lit("Please review this invoice manually.").alias("email_body"),
        F.concat(F.lit("Fallback triggered: "), reason).alias("reasoning"),
        F.lit("N/A — fallback").alias("playbook_reference"),
    )


def restore_name(text: Column, name: Column) -> Column:
    return F.replace(text, F.lit(schema.NAME_MASK), F.coalesce(name, F.lit("")))


def fix_body(text: Column, raw_id: Column, raw_date: Column) -> Column:
    """Replace the raw id and raw due date in a text by their readable forms."""
    swapped = F.when(F.length(raw_id) > 0, F.replace(text, raw_id, format_id(raw_id))).otherwise(text)
    return F.when(F.length(raw_date) > 0, F.replace(swapped, raw_date, format_date(raw_date))).otherwise(swapped)


def section_label(source: Column, section: Column) -> Column:
    return F.concat(source, F.lit(" — "), F.coalesce(section, F.lit("")))
