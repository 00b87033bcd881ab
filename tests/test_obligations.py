"""The ladder of reasons on literal obligations: each row fails one check more than the one that calculates."""

from datetime import date

from caseloom.plans import obligations

SCHEMA = (
    "name string, domain string, regime string, jurisdiction string, regimes array<string>, trigger_text string, communication_code string, communicated boolean, rule_id string, n_rules int, "
    "term_value int, term_unit string, rule_value int, rule_unit string, role string, rule_roles array<string>, procedure_class string, rule_classes array<string>, policy string, "
    "available_on date, published_on date, calculation_code string"
)
GOOD = {
    "domain": "CIVIL", "regime": "CPC", "jurisdiction": "SP", "regimes": ["CPC"], "communicated": True, "rule_id": "R01", "n_rules": 1, "term_value": 15, "term_unit": "BUSINESS_DAYS",
    "role": "DEFENDANT", "rule_roles": ["DEFENDANT"], "procedure_class": "A", "rule_classes": ["A", "B"], "available_on": date(2026, 3, 2),
}
CASES = {
    "": {},
    "LEGAL_CONTEXT_MISSING": {"regimes": []},
    "HEARING_TRIGGER_NOT_CONFIRMED": {"trigger_text": "contados a partir da Audiência"},
    "MEASURE_EFFECTIVENESS_TRIGGER_NOT_CONFIRMED": {"trigger_text": "da efetivação da medida"},
    "COMMUNICATION_CANCELED": {"communication_code": "COMMUNICATION_CANCELED", "rule_id": None},
    "RESOLVED_RULE_MISSING": {"rule_id": ""},
    "RESOLVED_RULE_NOT_FOUND": {"n_rules": 2},
    "TERM_INPUT_MISSING": {"term_unit": "UNSPECIFIED", "rule_value": 0, "rule_unit": "DAYS"},
    "RECIPIENT_ROLE_MISSING_OR_INCOMPATIBLE": {"role": None},
    "PROCEDURE_CLASS_MISSING_OR_INCOMPATIBLE": {"procedure_class": "C"},
    "COMMUNICATION_POLICY_MISSING": {"communicated": False},
    "COMMUNICATION_TRIGGER_MISSING": {"available_on": None},
    "CALENDAR_COVERAGE_MISSING": {"calculation_code": "CALENDAR_COVERAGE_MISSING"},
    "COUNTING_BOUNDARY_UNSPECIFIED": {"calculation_code": "COUNTING_BOUNDARY_UNSPECIFIED"},
}


def test_each_reason_in_its_turn(spark):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    worse, rows = {}, []
    for name, change in CASES.items():
        rows.append([(GOOD | change | {"name": name}).get(c) for c in names])
    # with all that went wrong before it, the earlier reason is told
    for name in list(CASES)[:0:-1]:
        worse = worse | CASES[name]
        rows.append([(GOOD | worse | {"name": name}).get(c) for c in names])
    rows.append([(GOOD | {"name": "", "rule_id": obligations.EXPLICIT, "n_rules": 0, "rule_roles": [], "rule_classes": None, "role": None}).get(c) for c in names])
    rows.append([(GOOD | {"name": "", "term_value": None, "rule_value": 5, "rule_unit": "DAYS", "policy": "P", "communicated": None}).get(c) for c in names])
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select("name", obligations.reason_of(df).alias("r"), obligations.status_of(obligations.reason_of(df)).alias("s")).collect()
    told = [(r["name"], r["r"] or "") for r in got]
    assert [x for x in told if x[0] != x[1] and not {"HEARING_TRIGGER_NOT_CONFIRMED", "MEASURE_EFFECTIVENESS_TRIGGER_NOT_CONFIRMED"} & set(x)] == []
    assert {r["s"] for r in got if r["name"] == ""} == {"CALCULATED"} and {r["s"] for r in got if r["name"].endswith("UNSPECIFIED")} == {"REVIEW_REQUIRED"}
