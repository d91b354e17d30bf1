from pyspark.sql import functions as F

from caseweave.functions import fixed_values as V
from caseweave.functions.text import span_text
from caseweave.operators import mappers as M
from caseweave.operators.forms import extract_forms
from caseweave.operators.windows import BLOCK

SCHEMA = "case_id string, doc_id string, unit_index bigint, kind string, cells array<string>, sheet string, block_number int"


def table(spark, rows):
    """rows: (doc, kind, cells, sheet, block) in order."""
    seen = {}
    out = []
    for doc, kind, cells, sheet, block in rows:
        seen[doc] = seen.get(doc, -1) + 1
        out.append(("c", doc, seen[doc], kind, cells, sheet, block))
    return spark.createDataFrame(out, SCHEMA)


CALLS = ["Caller ID", "Receiver ID", "Duration_Sec"]


def test_call_logs(spark):
    row = lambda doc, *cells, sheet=None, block=None: (doc, "row", list(cells), sheet, block)
    units = table(spark, [
        row("plain", *CALLS), row("plain", " 9876543210", "+91 9123456789", "0"), row("plain", "missing", "9123456789", "5"),
        row("plain", "9876543210", "9123456789", "bad"), row("plain", "9876543210"),
        row("sheets", *CALLS, sheet="Calls"), row("sheets", "9876543210", "9123456789", "1", sheet="Other"),
        row("sheets", "9876543210", "9123456789", "1", sheet="Calls"),
        row("blocks", *CALLS, block=1), row("blocks", "9876543210", "9123456789", "1", block=2),
        row("ambiguous", "FROM", "TO", "AMOUNT"), row("ambiguous", "9876543210", "9123456789", "1"),
        row("popped", *CALLS), row("popped", "FROM", "TO", "AMOUNT"), row("popped", "9876543210", "9123456789", "1"),
        row("reset", *CALLS), ("reset", "text", None, None, None), row("reset", "9876543210", "9123456789", "1"),
        row("far", *CALLS)]).union(spark.createDataFrame(
            [("c", "far", 3 * BLOCK + 1, "row", ["9876543210", "9123456789", "7"], None, None)], SCHEMA))
    out = {k: v.collect() for k, v in M.map_calls(units).items()}
    per_doc = sorted((e["doc_id"], e["unit_index"], e["duration_seconds"]) for e in out["edges"] if e["doc_id"] != "plain")
    assert per_doc == [("far", 3 * BLOCK + 1, 7.0), ("sheets", 2, 1.0)]
    plain = {e["unit_index"]: e for e in out["edges"] if e["doc_id"] == "plain"}
    assert set(plain) == {1, 3} and plain[1]["duration_seconds"] == 0.0 and plain[3]["event"] == {"durationRaw": "bad"}
    assert sorted((w["unit_index"], w["reason"][:8]) for w in out["warnings"]) == [(2, "caller o"), (3, "duration"), (4, "caller o")]
    assert len(out["entities"]) == 2 and all(m["snippet"][m["start"]:m["end"]] == m["label"] for m in out["mentions"])
    handled = {(h["doc_id"], h["unit_index"]) for h in out["handled"]}
    assert ("plain", 2) in handled and ("ambiguous", 0) not in handled and ("popped", 2) not in handled


def test_bank_rows(spark):
    row = lambda *cells: ("bank", "row", list(cells), None, None)
    units = table(spark, [row("From Account", "To Account", "Amount", "Date", "Type"), row("ACC10001", "ACC10002", "50,000", "2026-10-01", "NEFT"),
                          row("ACC10002", "ACC10003", "48000", "2026-10-02", "upi"), row("", "ACC1", "1", "", ""), row("From", "To", "", "", ""),
                          row("ACC1", "ACC2")])
    edges = sorted(M.map_transfers(units)["edges"].collect(), key=lambda e: e["unit_index"])
    assert [(e["type"], e["amount"], e["payment_method"]) for e in edges] == [
        ("TRANSFERRED_TO", "50,000", "NEFT"), ("SENT_UPI", "48000", "UPI"), ("TRANSFERRED_TO", None, "TRANSFER")]
    assert edges[0]["evidence_text"] == "Transferred 50,000 from ACC10001 to ACC10002 on 2026-10-01"
    assert edges[2]["evidence_text"] == "Transferred  from ACC1 to ACC2"


def test_registry_rows(spark):
    row = lambda doc, *cells: (doc, "row", list(cells), None, None)
    units = table(spark, [
        row("dir", "oncompany_id", "person_id", "role"), row("dir", "C1", "P1", "Chair"),
        row("veh", "vehicle_id", "registration_number", "owner_person_id", "make"), row("veh", "V1", "DL8CAB1234", "P1", "Tata"),
        row("veh", "V2", "", "P2", "x"), row("veh", "location_id", "name", "city"), row("veh", "L1", "Depot", "Pune"), row("veh", "L2", "", "Goa")])
    out = M.map_registry(units)
    edges = out["edges"].collect()
    assert [(e["type"], e["evidence_text"], e["confidence"]) for e in edges] == [("OWNS_VEHICLE", "P1 owns vehicle DL8CAB1234", 0.98)]
    entities = {(e["type"], e["label"]): e for e in out["entities"].collect()}
    assert set(entities) == {("Vehicle", "DL8CAB1234"), ("ExternalRef", "P1"), ("Location", "Depot, Pune"), ("Location", "Goa")}
    assert entities["Vehicle", "DL8CAB1234"]["attrs"] == {"make": "Tata"} and entities["Location", "Goa"]["external_id"] == "L2"
    assert {h["doc_id"] for h in out["handled"].collect()} == {"veh"}


def test_report_form(spark):
    text = """FIR Number: FIR-104-SYN
        Investigating Officer: Inspector A. Verma

        ENT-001    Rahul Sharma    Primary accused
        ENT-002    Rajesh Bindal   Frequent associate
        ORG-001    Bindal Exports  Shell company

        Repeated calls among Rahul Sharma and Rajesh Bindal.
        INFORMANT:
           Name: Someone"""
    entities, edges = extract_forms(spark.createDataFrame([("c", "d", text)], "case_id string, doc_id string, text string"))
    assert {e["label"] for e in entities.collect()} == {"FIR FIR-104-SYN", "A. Verma", "Rahul Sharma", "Rajesh Bindal", "Bindal Exports"}
    got = sorted((e["type"], e["evidence_text"]) for e in edges.collect())
    assert [g[0] for g in got] == ["ACCUSED_IN", "CONTACTED", "INVESTIGATED", "MENTIONED_IN", "MENTIONED_IN"]
    assert got[2][1] == "A. Verma Investigating Officer for FIR FIR-104-SYN"
