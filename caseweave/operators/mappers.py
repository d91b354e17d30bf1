"""Header-driven mappers for call logs, bank statements and registry tables.

Input units: (case_id, doc_id, unit_index, kind, cells, sheet, block_number).
A recognised header row sets the column positions for the rows after it; the
positions travel forward with a blocked running maximum (see ``windows``), so a
single huge table is still spread over many tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.identifiers import (alias_list, cell, column_span, edge_id, entity_id_from_value, map_roles,
                                     nfkc, norm_header, normalized, valid_call_number)
from ..functions.scoring import drop_empty, parse_duration
from ..functions.text import let
from .windows import running_max

KEYS = ["case_id", "doc_id"]


def _names(cells: Column) -> Column:
    return F.transform(cells, norm_header)


def _overlaps(names: Column, aliases: str) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(a) for a in alias_list(aliases)]))


def table_group(df: DataFrame) -> Column:
    """Sheet name, or the table number for document tables."""
    sheet = F.col("sheet") if "sheet" in df.columns else F.lit(None).cast("string")
    block = F.col("block_number") if "block_number" in df.columns else F.lit(None).cast("int")
    return F.when(block.isNotNull(), F.concat(F.lit("docx-table:"), block.cast("string"))) \
            .otherwise(F.coalesce(sheet, F.lit("")))


def _carry(units: DataFrame, header: Column, grouped: bool) -> DataFrame:
    """Rows with ``header`` (this row's own, or NULL) and ``active``: the header in
    force, NULL where none applies.  ``header`` is struct(ok, …), orderable.

    A unit that is not a row ends every table of its document. It breaks only tables that have a header before it and no
    such unit between, so there are no more breaks than headers, however many groups and such units a document has.
    """
    with_group = units.withColumn("table_group", table_group(units) if grouped else F.lit(""))
    rows = with_group.filter(F.col("kind") == "row").withColumn("header", header)
    found = rows.filter("header is not null").select(*KEYS, "table_group", "unit_index")
    stops = units.filter(F.col("kind") != "row").select(*KEYS, "unit_index", F.lit(True).alias("stop"))
    # from the end of a document to its start, the greatest of the negated places is the nearest stop behind
    backwards = found.unionByName(stops, allowMissingColumns=True).withColumn("back", -F.col("unit_index"))
    nearest = running_max(backwards, KEYS, "back", {"nearest": F.when(F.col("stop"), F.col("back"))})
    breaks = (nearest.filter("stop is null and nearest is not null").select(*KEYS, "table_group", (-F.col("nearest")).alias("unit_index"))
              .distinct().withColumn("kind", F.lit("break")))
    events = rows.unionByName(breaks, allowMissingColumns=True)
    state = F.when(F.col("kind") == "break", F.struct(F.col("unit_index"), F.lit(None).cast(
        rows.schema["header"].dataType).alias("header"))).when(
        F.col("header").isNotNull(), F.struct("unit_index", "header"))
    carried = running_max(events, [*KEYS, "table_group"], "unit_index", {"state": state})
    active = F.when(F.col("state.header.ok"), F.col("state.header"))
    return carried.filter(F.col("kind") == "row").withColumn("active", active).drop("state")


def call_headers(units: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rows with the call-log header in force.  Generic from/to headers count only
    next to call evidence; otherwise they end the previous header."""
    roles = aliases or V.CALL_ALIASES
    order = list(roles)
    at = {r: order.index(r) for r in order}

    def build(names):
        def verdict(pos):
            source = F.try_element_at(names, F.nullif(pos[at["caller"]], F.lit(0)))
            target = F.try_element_at(names, F.nullif(pos[at["receiver"]], F.lit(0)))
            explicit = source.startswith("caller") & (target.startswith("receiver") | target.startswith("callee"))
            evidence = F.array_contains(names, F.lit("callid"))
            for role in ("duration", "callType", "cellTower"):
                evidence = evidence | (pos[at[role]] > 0)
            return F.struct((explicit | evidence).alias("ok"), pos.alias("pos"))
        return F.when(_overlaps(names, roles["caller"]) & _overlaps(names, roles["receiver"]),
                      let(map_roles(names, roles), verdict))

    return _carry(units, let(_names(F.col("cells")), build), grouped=True)


def bank_headers(units: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    roles = aliases or V.BANK_ALIASES

    def build(names):
        return F.when(_overlaps(names, roles["from_account"]) & _overlaps(names, roles["to_account"]),
                      F.struct(F.lit(True).alias("ok"), map_roles(names, roles).alias("pos")))

    return _carry(units, let(_names(F.col("cells")), build), grouped=True)


def registry_headers(units: DataFrame, schemas: dict[str, dict[str, str]] | None = None,
                     required: dict[str, str] | None = None) -> DataFrame:
    """One schema in force per document; the first matching schema in declared order wins."""
    schemas, required = schemas or V.REGISTRY_ALIASES, required or V.REGISTRY_REQUIRED
    any_required = sorted({a for s in schemas for r in alias_list(required[s])
                                    for a in alias_list(schemas[s][r])})

    def build(names):
        choices = []
        for schema, roles in schemas.items():
            complete = F.lit(True)
            for role in alias_list(required[schema]):
                complete = complete & _overlaps(names, roles[role])
            choices.append(F.when(complete, F.struct(F.lit(True).alias("ok"), F.lit(schema).alias("schema"),
                                                     map_roles(names, roles).alias("pos"))))
        return F.when(_overlaps(names, any_required), F.coalesce(*choices))

    return _carry(units, let(_names(F.col("cells")), build), grouped=False)


def _scope(df: DataFrame) -> Column:
    return F.concat(F.lit("case:"), F.col("case_id"))


def _with_id(df: DataFrame, label: str, kind: str, out: str, ascii_only: bool = False) -> DataFrame:
    value = normalized(F.col(label) if ascii_only else nfkc(F.col(label)), F.col(kind))
    return df.withColumn(out + "_value", value).withColumn(
        out, entity_id_from_value(F.col(out + "_value"), F.col(kind), _scope(df)))


def row_text(cells: Column) -> Column:
    return F.array_join(cells, " | ")


def map_calls(units: DataFrame, aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Call rows to edges, mentions, entities, handled units and quarantined rows."""
    roles = aliases or V.CALL_ALIASES
    order = list(roles)
    rows = call_headers(units, roles)
    header_rows = rows.filter(F.col("header.ok"))
    data = rows.filter(F.col("header").isNull() & F.col("active").isNotNull())

    def value(role):
        return cell(F.col("cells"), F.col("active.pos")[order.index(role)])

    data = data.withColumns({"caller": value("caller"), "receiver": value("receiver")})
    valid = valid_call_number(F.col("caller")) & valid_call_number(F.col("receiver"))
    good = data.filter(valid)
    rejected = data.filter(~valid).select(*KEYS, "unit_index", F.lit(
        "caller or receiver is not a valid phone number").alias("reason"))
    duration = value("duration")
    seconds = parse_duration(duration)
    details = [r for r in order if r not in ("caller", "receiver", "duration")]
    event = drop_empty(F.create_map(
        *[x for r in details for x in (F.lit(r), value(r))],
        F.lit("durationRaw"), F.when(seconds.isNull(), duration)))
    text = row_text(F.col("cells"))
    # accepted numbers hold only ASCII digits and punctuation
    edges = (good.withColumn("kind_phone", F.lit("Phone"))
             .transform(lambda d: _with_id(d, "caller", "kind_phone", "source", ascii_only=True))
             .transform(lambda d: _with_id(d, "receiver", "kind_phone", "target", ascii_only=True))
             .withColumn("evidence_text", text)
             .select(*KEYS, "unit_index", edge_id("call", F.col("table_group"), F.col("unit_index"),
                                                  F.col("evidence_text")).alias("id"),
                     "source", "target", F.lit("CALLED").alias("type"), F.lit("recorded").alias("origin"),
                     F.lit("pending").alias("review_status"), F.lit("structured-column").alias("method"),
                     F.lit("call-log-columns").alias("rule_id"), F.lit(0).alias("start"),
                     F.length("evidence_text").alias("end"), "evidence_text", event.alias("event"),
                     seconds.alias("duration_seconds")))
    ends = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("label"),
                              F.col("active.pos")[order.index(r)].alias("column_number"))
                     for r in ("caller", "receiver")])
    mentions = (good.select(*KEYS, "unit_index", "cells", F.explode(ends).alias("m"))
                .select(*KEYS, "unit_index", "cells", "m.*")
                .withColumn("span", column_span(F.col("cells"), F.col("column_number")))
                .withColumn("type", F.lit("Phone"))
                .transform(lambda d: _with_id(d, "label", "type", "entity_id", ascii_only=True))
                .select(*KEYS, "unit_index", "entity_id", "entity_id_value", "label", "type", "role",
                        "column_number", F.col("span.start").alias("start"), F.col("span.end").alias("end"),
                        F.lit("structured-column").alias("method"), row_text(F.col("cells")).alias("snippet")))
    entities = (mentions.groupBy("case_id", F.col("entity_id").alias("id"))
                .agg(F.max_by("label", F.struct("doc_id", "unit_index", "start")).alias("label"),
                     F.first("entity_id_value").alias("normalized_value"))
                .withColumn("type", F.lit("Phone")))
    bad_duration = good.filter((duration != "") & seconds.isNull()).select(
        *KEYS, "unit_index", F.lit("duration is not a nonnegative number of seconds").alias("reason"))
    handled = header_rows.select("doc_id", "unit_index").union(data.select("doc_id", "unit_index"))
    return {"entities": entities, "mentions": mentions, "edges": edges, "handled": handled,
            "warnings": rejected.unionByName(bad_duration)}


def map_transfers(units: DataFrame, aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Bank rows to account entities and SENT_UPI / TRANSFERRED_TO edges."""
    roles = aliases or V.BANK_ALIASES
    order = list(roles)
    rows = bank_headers(units, roles)

    def value(role):
        return cell(F.col("cells"), F.col("active.pos")[order.index(role)])

    def optional(role):
        return F.when(F.col("active.pos")[order.index(role)].between(1, F.size("cells")), value(role))

    data = (rows.filter(F.col("header").isNull() & F.col("active").isNotNull())
            .withColumns({"from_raw": value("from_account"), "to_raw": value("to_account")})
            .filter((F.col("from_raw") != "") & (F.col("to_raw") != "")
                    & (F.lower("from_raw") != "from") & (F.lower("to_raw") != "to"))
            .withColumns({"amount": optional("amount"), "timestamp": optional("timestamp"),
                          "payment_method": F.coalesce(F.upper(optional("txn_type")), F.lit("TRANSFER")),
                          "acct": F.lit("Account")})
            .transform(lambda d: _with_id(d, "from_raw", "acct", "source"))
            .transform(lambda d: _with_id(d, "to_raw", "acct", "target")))
    evidence = F.concat(F.lit("Transferred "), F.coalesce("amount", F.lit("")), F.lit(" from "), F.col("from_raw"),
                        F.lit(" to "), F.col("to_raw"),
                        F.when(F.coalesce("timestamp", F.lit("")) != "", F.concat(F.lit(" on "), F.col("timestamp")))
                        .otherwise(F.lit("")))
    edges = data.select(
        *KEYS, "unit_index", F.concat(F.lit("rel:tx-"), F.col("unit_index").cast("string")).alias("id"),
        "source", "target",
        F.when(F.col("payment_method").contains("UPI"), F.lit("SENT_UPI")).otherwise(F.lit("TRANSFERRED_TO")).alias("type"),
        F.lit(0.95).alias("confidence"), F.lit("bank-row-mapper").alias("method"),
        F.lit("observed").alias("origin"), "amount", F.col("amount").try_cast("decimal(18,2)").alias("amount_value"),
        "timestamp", "payment_method", evidence.alias("evidence_text"),
        F.lit("structured-bank-row").alias("rule_id"))
    ends = F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("from_raw").alias("label"), F.col("source_value").alias("v")),
        F.struct(F.col("target").alias("id"), F.col("to_raw").alias("label"), F.col("target_value").alias("v"))))
    entities = (data.select("case_id", "doc_id", "unit_index", ends.alias("e"))
                .groupBy("case_id", F.col("e.id").alias("id"))
                .agg(F.max_by("e.label", F.struct("doc_id", "unit_index")).alias("label"),
                     F.first("e.v").alias("normalized_value"))
                .withColumn("type", F.lit("Account")))
    handled = rows.filter(F.col("header").isNotNull()).select("doc_id", "unit_index").union(
        data.select("doc_id", "unit_index"))
    return {"entities": entities, "edges": edges, "handled": handled}


# --- registry schemas -----------------------------------------------------------

def _entity(label: Column, kind, external: Column, **attrs: Column) -> Column:
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v)]
    bag = drop_empty(F.create_map(*pairs)) if pairs else F.expr("cast(map() as map<string,string>)")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(label != "", F.struct(label.alias("label"), kind.alias("type"), external.alias("external_id"),
                                        bag.alias("attrs")))


def _edge(when: Column, kind: str, source: Column, source_kind, target: Column, target_kind,
          evidence: Column, timestamp: Column | None = None, **attrs: Column) -> Column:
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v)]
    bag = drop_empty(F.create_map(*pairs)) if pairs else F.expr("cast(map() as map<string,string>)")
    as_col = lambda k: F.lit(k) if isinstance(k, str) else k
    return F.when(when, F.struct(
        F.lit(kind).alias("type"), source.alias("source_label"), as_col(source_kind).alias("source_kind"),
        target.alias("target_label"), as_col(target_kind).alias("target_kind"), evidence.alias("evidence_text"),
        (F.lit(None).cast("string") if timestamp is None else timestamp).alias("timestamp"), bag.alias("attrs")))


def _findings(schema: str, v) -> tuple[list[Column], list[Column]]:
    """Entities and edges one registry row yields; ``v(role)`` is a trimmed cell."""
    none = F.lit("")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    either = lambda value, default: F.when(value != "", value).otherwise(F.lit(default))
    ref = lambda value: _entity(value, "ExternalRef", value)
    if schema == "accounts":
        number, holder, upi = v("account_number"), v("holder_id"), v("upi_id")
        has = number != ""
        return ([_entity(number, "Account", v("account_id"), bank=v("bank_id"), accountType=v("account_type")),
                 F.when(has, ref(holder)), F.when(has, _entity(upi, "UPI", none))],
                [_edge(has & (holder != ""), "HOLDER_OF", holder, "ExternalRef", number, "Account",
                       text(holder, " holds account ", number)),
                 _edge(has & (upi != ""), "HAS_UPI", number, "Account", upi, "UPI",
                       text("Account ", number, " linked to UPI ", upi))])
    if schema == "kyc":
        name, phone = v("name"), v("phone")
        return ([_entity(name, "Person", v("person_id"), nationalId=v("national_id"), dob=v("dob"),
                         address=v("address"), email=v("email")),
                 F.when(name != "", _entity(phone, "Phone", none))],
                [_edge((name != "") & (phone != ""), "HAS_PHONE", name, "Person", phone, "Phone",
                       text("KYC: ", name, " has phone ", phone))])
    if schema == "company_registry":
        name, number, account = v("company_name"), v("reg_number"), v("bank_account_id")
        label = F.when((name != "") & (number != ""), text(name, " (", number, ")")).otherwise(name)
        return ([_entity(label, "Organization", v("company_id"), registrationNumber=number,
                         companyType=v("company_type")),
                 F.when(name != "", _entity(account, "Account", account))],
                [_edge((name != "") & (account != ""), "OPERATES_ACCOUNT", label, "Organization", account, "Account",
                       text(name, " operates account ", account))])
    if schema == "company_directors":
        company, person, role = v("company_id"), v("person_id"), either(v("role"), "Director")
        both = (company != "") & (person != "")
        return ([F.when(both, ref(person)), F.when(both, ref(company))],
                [_edge(both, "DIRECTOR_OF", person, "ExternalRef", company, "ExternalRef",
                       text(person, " is ", role, " of ", company), role=role, startDate=v("start_date"))])
    if schema == "vehicles":
        plate, owner = v("reg_number"), v("owner_id")
        return ([_entity(plate, "Vehicle", v("vehicle_id"), vehicleType=v("vehicle_type"), make=v("make"),
                         model=v("model"), year=v("year")),
                 F.when(plate != "", ref(owner))],
                [_edge((plate != "") & (owner != ""), "OWNS_VEHICLE", owner, "ExternalRef", plate, "Vehicle",
                       text(owner, " owns vehicle ", plate))])
    if schema == "vehicle_events":
        vehicle, place, ts = v("vehicle_id"), v("location_id"), v("timestamp")
        kind = either(v("event_type"), "seen_at")
        both = (vehicle != "") & (place != "")
        return ([F.when(both, ref(vehicle)), F.when(both, ref(place))],
                [_edge(both, "VEHICLE_SEEN_AT", vehicle, "ExternalRef", place, "ExternalRef",
                       text("Vehicle ", vehicle, " ", kind, " at ", place, " on ", ts), ts,
                       eventType=kind, eventId=v("event_id"))])
    if schema == "locations":
        key, city = v("location_id"), v("city")
        name = F.when(v("name") != "", v("name")).otherwise(city)
        label = F.when((name != "") & (city != "") & (name != city), text(name, ", ", city)).otherwise(name)
        return ([F.when(key != "", _entity(
            label, "Location", key, city=city, state=v("state"), country=v("country"), latitude=v("lat"),
            longitude=v("lon"), address=v("address"), locationType=v("loc_type")))], [])
    if schema == "cyber_events":
        who, ip, domain, ts = v("source_entity_id"), v("ip_address"), v("domain_name"), v("timestamp")
        kind = either(v("event_type"), "cyber_event")
        label = F.when(domain != "", domain).otherwise(ip)
        label_kind = F.when(domain != "", F.lit("Domain")).otherwise(F.lit("Location"))
        return ([ref(who), F.when(who != "", _entity(label, label_kind, label))],
                [_edge((who != "") & (label != ""), "CYBER_EVENT", who, "ExternalRef", label, label_kind,
                       text(who, " ", kind, " on ", label, " at ", ts), ts, eventType=kind, ipAddress=ip,
                       deviceId=v("device_id"), outcome=v("outcome"))])
    if schema == "emails":
        sender, receiver, ts = v("sender"), v("receiver"), v("timestamp")
        both = (sender != "") & (receiver != "")
        return ([F.when(both, _entity(sender, "Person", none)), F.when(both, _entity(receiver, "Person", none))],
                [_edge(both, "EMAILED", sender, "Person", receiver, "Person",
                       text(sender, " emailed ", receiver, " at ", ts), ts, ipAddress=v("ip_address"),
                       domain=v("domain"))])
    if schema == "ip_events":
        who, ip, ts = v("person_id"), v("ip_address"), v("timestamp")
        kind = either(v("event_type"), "ip_activity")
        both = (who != "") & (ip != "")
        return ([F.when(both, ref(who)), F.when(both, _entity(ip, "Location", ip))],
                [_edge(both, "IP_ACTIVITY", who, "ExternalRef", ip, "Location",
                       text(who, " ", kind, " from ", ip, " at ", ts), ts, eventType=kind, deviceId=v("device_id"))])
    if schema == "domains":
        return ([_entity(v("domain"), "Domain", v("domain_id"), registrar=v("registrar"), status=v("status"))], [])
    raise ValueError(f"unknown registry schema {schema}")


ENTITY_ITEM = "array<struct<label:string,type:string,external_id:string,attrs:map<string,string>>>"
EDGE_ITEM = ("array<struct<type:string,source_label:string,source_kind:string,target_label:string,"
             "target_kind:string,evidence_text:string,timestamp:string,attrs:map<string,string>>>")


def map_registry(units: DataFrame, only: str | None = None,
                 schemas: dict[str, dict[str, str]] | None = None) -> dict[str, DataFrame]:
    """Registry rows to entities and edges, in one pass over the rows for all schemas."""
    schemas = schemas or V.REGISTRY_ALIASES
    rows = registry_headers(units, schemas)
    data = rows.filter(F.col("header").isNull() & F.col("active").isNotNull())
    if only:
        data = data.filter(F.col("active.schema") == only)
    found_entities, found_edges = F.lit(None).cast(ENTITY_ITEM), F.lit(None).cast(EDGE_ITEM)
    for schema in ([only] if only else list(schemas)):
        order = list(schemas[schema])
        entities, edges = _findings(
            schema, lambda role: cell(F.col("cells"), F.col("active.pos")[order.index(role)]))
        match = F.col("active.schema") == schema
        found_entities = F.when(match, F.array_compact(F.array(*entities)).cast(ENTITY_ITEM)).otherwise(found_entities)
        if edges:
            found_edges = F.when(match, F.array_compact(F.array(*edges)).cast(EDGE_ITEM)).otherwise(found_edges)
    base = [*KEYS, "unit_index", F.col("active.schema").alias("schema")]
    entities = (data.select(*base, F.posexplode(found_entities).alias("pos", "e"))
                .select(*KEYS, "unit_index", "schema", "pos", "e.*")
                .transform(lambda d: _with_id(d, "label", "type", "id"))
                .withColumnRenamed("id_value", "normalized_value"))
    edges = (data.select(*base, F.explode(found_edges).alias("e")).select(*KEYS, "unit_index", "schema", "e.*")
             .transform(lambda d: _with_id(d, "source_label", "source_kind", "source"))
             .transform(lambda d: _with_id(d, "target_label", "target_kind", "target"))
             .select(*KEYS, "unit_index", "schema",
                     edge_id("reg", F.col("type"), F.col("source"), F.col("target"), F.col("unit_index")).alias("id"),
                     "source", "target", "type", F.lit(0.98).alias("confidence"),
                     F.lit("registry-row-mapper").alias("method"), F.lit("recorded").alias("origin"),
                     F.concat(F.lit("registry-"), F.lower("type")).alias("rule_id"), "evidence_text", "timestamp",
                     "source_label", "target_label", "attrs"))
    handled = rows.filter(F.col("header").isNotNull() | F.col("active").isNotNull()).select("doc_id", "unit_index")
    return {"entities": entities, "edges": edges, "handled": handled}
