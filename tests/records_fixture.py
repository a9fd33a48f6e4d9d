"""Small business records, built in code."""

from rulespark.plans.records import ENTITIES, FILES, RECORDS, Context


def cell(text="", state=None, deleted=(), raw=None):
    """A cell; ``raw`` is the whole text, in which ``deleted`` texts have their places."""
    state = state or ("value" if text else "empty")
    spans = [{"text": t, "start": max((raw or "").find(t), 0), "end": max((raw or "").find(t), 0) + len(t)} for t in deleted]
    return {"raw": text if raw is None else raw, "current": text, "coordinate": "A1", "formula": None, "cached": None, "state": state, "deleted_spans": spans, "deleted_unavailable": False, "red_spans": []}


def record(kind, row, entity="205H", business="06", variant="default", sheet="s", file="f.xlsx", people=(), **fields):
    return {
        "record_type": kind, "entity_code": entity, "business_code": business, "business_id": business, "variant_id": variant, "file_path": file, "sheet": sheet, "row": row,
        "fields": {k: v if isinstance(v, dict) else cell(v) for k, v in fields.items()}, "record_id": None,
        "person_keys": [{"name": n, "person_id": i, "identity_reliable": bool(i)} for n, i in people],
    }


def duty(row, **fields):
    base = {"measure_id": "X-1-控制措施1", "role": "经办", "person_names": "甲", "department": "财务部", "position": "会计", "duty": "对真实性负主体责任"}
    base |= fields
    people = base.pop("people", [(base["person_names"], None)] if isinstance(base["person_names"], str) else [])
    where = {k: base.pop(k) for k in ("entity", "business", "variant", "sheet", "file") if k in base}
    return record("position_duty", row, people=people, **where, **{k: v for k, v in base.items() if v is not None})


def matrix(row, **fields):
    base = {"measure_id": "X-1-控制措施1", "applicability": "适用", "responsibility": "财务部-会计", "carrier": "", "control_measure": ""} | fields
    where = {k: base.pop(k) for k in ("entity", "business", "variant", "sheet", "file") if k in base}
    return record("matrix", row, **where, **{k: v for k, v in base.items() if v is not None})


def file(path="f.xlsx", sheets=("matrix", "position_duty"), entity="205H", business="06", **more):
    base = {
        "entity_code": entity, "business_code": business, "business_id": business, "variant_id": "default", "relative_path": path, "sha256": path, "true_format": "xlsx", "material_type": "matrix",
        "entity_conflict": False, "parse_errors": [], "sheets": [{"title": s, "sheet_type": s, "columns": ["measure_id"], "headers": ["编号"]} for s in sheets],
    }
    return base | more


def context(spark, records, files=None, **more):
    files = [file()] if files is None else files
    return Context(
        spark.createDataFrame(records, RECORDS),
        spark.createDataFrame(files, FILES),
        spark.createDataFrame([("205H", "甲县供电公司", None, None, True)], ENTITIES),
        **({"scope_entities": ["205H"], "scope_businesses": [{"business_code": "06"}]} | more),
    )
