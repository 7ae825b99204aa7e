"""The monitored platform's vocabulary: services, components, codes, dependencies and their limits.

Dimension tables of fixed, small size. `load_yaml` reads another platform from two files of the same
layout and validates it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the platform. Services by code:
SERVICES = {"PAY": "payment-remittance", "CLM": "claims-adjudication", "ELG": "member-eligibility", "PRV": "provider-enrollment", "ADM": "admin-integrity"}
# component, service, criticality, lines a second, error rate, warning rate, median latency in ms, name
COMPONENTS = (
    ("RMT", "PAY", 0.9, 60, 0.006, 0.004, 42, "remit-generator"),
    ("EXP", "PAY", 0.8, 8, 0.003, 0.0, 260, "payment-file-export"),
    ("LDG", "PAY", 0.9, 120, 0.002, 0.0, 9, "ledger-writer"),
    ("BNK", "PAY", 0.95, 4, 0.010, 0.0, 900, "bank-gateway"),
    ("EDT", "CLM", 1.0, 250, 0.008, 0.06, 38, "edit-engine"),
    ("PRC", "CLM", 0.7, 220, 0.003, 0.0, 27, "pricing-engine"),
    ("DUP", "CLM", 0.6, 250, 0.002, 0.0012, 11, "duplicate-check"),
    ("STR", "CLM", 1.0, 300, 0.002, 0.0, 7, "claim-store"),
    ("X12", "ELG", 0.7, 180, 0.004, 0.0, 22, "x12-270-271-gateway"),
    ("MBR", "ELG", 0.9, 320, 0.002, 0.004, 8, "member-lookup"),
    ("CCH", "ELG", 0.6, 400, 0.001, 0.002, 2, "eligibility-cache"),
    ("CVR", "ELG", 0.5, 150, 0.003, 0.0, 17, "coverage-rules"),
    ("INT", "PRV", 0.6, 25, 0.012, 0.03, 74, "enrollment-intake"),
    ("CRD", "PRV", 0.7, 30, 0.010, 0.0, 210, "credential-verify"),
    ("NPI", "PRV", 0.7, 40, 0.008, 0.0, 190, "npi-registry-client"),
    ("PST", "PRV", 0.8, 60, 0.002, 0.0, 33, "provider-store"),
    ("AUT", "ADM", 0.9, 90, 0.003, 0.02, 6, "auth-service"),
    ("AUD", "ADM", 1.0, 200, 0.0005, 0.0, 4, "audit-trail"),
    ("RPT", "ADM", 0.3, 5, 0.015, 0.0, 1400, "report-export"),
    ("FWA", "ADM", 0.7, 100, 0.004, 0.008, 88, "fwa-scorer"),
)
# code, component, share of the component's errors or warnings, typical and least latency in ms, message
CODES = (
    ("E5101", "RMT", 0.55, 850, 400, "REMIT_835_BUILD_FAILED remit=RMT-{n} reason=segment_count_mismatch"),
    ("E5102", "RMT", 0.45, 90, 40, "PAYEE_ADDRESS_MISSING provider=PRV-{n}"),
    ("W5103", "RMT", 1.0, 2200, 900, "REMIT_BATCH_SLOW batch=B-{n} ms={ms}"),
    ("E5201", "EXP", 0.5, 1400, 500, "ACH_FILE_WRITE_FAILED file=pay_{date}_{n}.ach errno=ENOSPC"),
    ("E5202", "EXP", 0.5, 700, 300, "FILE_CHECKSUM_MISMATCH file=pay_{date}_{n}.ach"),
    ("E5301", "LDG", 0.5, 310, 120, "LEDGER_TXN_ROLLBACK txn=LDG-{n} reason=deadlock"),
    ("E5302", "LDG", 0.5, 3000, 1500, "FUND_ACCOUNT_LOOKUP_TIMEOUT fund=F-{n} after_ms={ms}"),
    ("E5401", "BNK", 0.6, 30000, 10000, "BANK_SFTP_TIMEOUT host=bank-gw-{n} after_ms={ms}"),
    ("E5402", "BNK", 0.4, 18000, 5000, "BANK_ACK_REJECTED ack=R{nn} file=pay_{date}_{n}.ach"),
    ("E4110", "EDT", 0.5, 45, 20, "EDIT_ENGINE_RULESET_LOAD_FAILED ruleset=v{n}"),
    ("E4111", "EDT", 0.5, 2000, 800, "EDIT_EVAL_TIMEOUT claim=CLM-{n} edit=EDIT_{nn} after_ms={ms}"),
    ("W4101", "EDT", 0.25, 38, 20, "EDIT_0101 member_not_eligible claim=CLM-{n}"),
    ("W4102", "EDT", 0.15, 41, 20, "EDIT_0102 provider_not_enrolled claim=CLM-{n}"),
    ("W4103", "EDT", 0.30, 38, 20, "EDIT_0103 procedure_not_covered claim=CLM-{n} proc={cpt}"),
    ("W4104", "EDT", 0.20, 36, 20, "EDIT_0104 prior_auth_missing claim=CLM-{n}"),
    ("W4105", "EDT", 0.10, 34, 20, "EDIT_0105 timely_filing_exceeded claim=CLM-{n}"),
    ("E4210", "PRC", 0.5, 33, 15, "FEE_SCHEDULE_NOT_FOUND proc={cpt} dos={date}"),
    ("E4211", "PRC", 0.5, 61, 25, "PRICING_CALC_OVERFLOW claim=CLM-{n}"),
    ("E4310", "DUP", 0.7, 1200, 400, "DUP_INDEX_UNAVAILABLE shard={n}"),
    ("W4301", "DUP", 1.0, 120, 50, "DUPLICATE_CLAIM_SUSPECTED claim=CLM-{n} orig=CLM-{m}"),
    ("E4410", "STR", 0.6, 3000, 1200, "CLAIM_DB_TIMEOUT table=claims after_ms={ms}"),
    ("E4411", "STR", 0.4, 5, 2, "CLAIM_DB_CONN_POOL_EXHAUSTED pool=adj-rw"),
    ("E2101", "X12", 0.5, 26, 10, "X12_270_PARSE_ERROR isa=ISA-{n} segment=NM1"),
    ("E2102", "X12", 0.5, 2500, 900, "X12_271_RESPONSE_TIMEOUT payer=ST{nn} after_ms={ms}"),
    ("E2201", "MBR", 0.7, 2000, 800, "MEMBER_INDEX_TIMEOUT after_ms={ms}"),
    ("W2202", "MBR", 1.0, 12, 5, "MEMBER_NOT_FOUND member=MBR-{n}"),
    ("E2301", "CCH", 0.5, 350, 120, "CACHE_NODE_UNREACHABLE node=cache-{n}"),
    ("W2302", "CCH", 1.0, 3, 1, "CACHE_MISS_RATE_HIGH pct={n}"),
    ("E2401", "CVR", 0.5, 30, 12, "COVERAGE_RULES_STALE version=v{n}"),
    ("E2402", "CVR", 0.5, 55, 20, "SPAN_OVERLAP_UNRESOLVED member=MBR-{n}"),
    ("E3101", "INT", 0.7, 80, 30, "ENROLL_FORM_VALIDATION_FAILED app=APP-{n} field=taxonomy"),
    ("W3102", "INT", 1.0, 75, 30, "ENROLL_DOC_MISSING app=APP-{n} doc=W9"),
    ("E3201", "CRD", 0.6, 3000, 1000, "LICENSE_BOARD_API_TIMEOUT state={state} after_ms={ms}"),
    ("E3202", "CRD", 0.4, 220, 80, "EXCLUSION_CHECK_FAILED npi={npi}"),
    ("E3301", "NPI", 0.65, 210, 80, "NPI_LOOKUP_5XX status=503 endpoint=npi-registry"),
    ("E3302", "NPI", 0.35, 40, 15, "NPI_RATE_LIMITED retry_after_s={n}"),
    ("E3401", "PST", 0.5, 420, 150, "PROVIDER_DB_DEADLOCK txn=PTX-{n}"),
    ("E3402", "PST", 0.5, 9000, 3000, "PROVIDER_INDEX_REBUILD_FAILED index=idx_npi"),
    ("E1101", "AUT", 0.45, 6, 2, "AUTH_TOKEN_VALIDATE_FAILED user=U-{n} reason=expired"),
    ("W1102", "AUT", 1.0, 6, 2, "AUTH_BAD_PASSWORD user=U-{n} ip=10.20.{a}.{b}"),
    ("E1103", "AUT", 0.55, 2000, 700, "IDP_UNREACHABLE idp=idp-{n} after_ms={ms}"),
    ("E1201", "AUD", 1.0, 40, 15, "AUDIT_WRITE_FAILED event=EVT-{n}"),
    ("E1301", "RPT", 0.5, 5000, 2000, "REPORT_TIMEOUT report=R-{n} after_ms={ms}"),
    ("E1302", "RPT", 0.5, 1800, 600, "EXPORT_OBJECT_PUT_FAILED bucket=rpt-exports"),
    ("E1401", "FWA", 0.4, 70, 25, "FWA_MODEL_LOAD_FAILED model=v{n}"),
    ("W1402", "FWA", 1.0, 95, 40, "FWA_SCORE_HIGH claim=CLM-{n} score=0.{nn}"),
)
# upstream, downstream, coupling, lag in seconds
EDGES = (
    ("ELG.CCH", "ELG.MBR", 0.5, 2), ("ELG.MBR", "ELG.X12", 0.6, 2), ("ELG.MBR", "CLM.EDT", 0.6, 3), ("PRV.PST", "CLM.EDT", 0.4, 3),
    ("CLM.EDT", "CLM.PRC", 0.5, 2), ("CLM.STR", "CLM.DUP", 0.6, 2), ("CLM.STR", "PAY.RMT", 0.5, 4), ("PAY.RMT", "PAY.EXP", 0.5, 3),
    ("PAY.EXP", "PAY.BNK", 0.5, 3), ("PRV.NPI", "PRV.CRD", 0.6, 2), ("PRV.CRD", "PRV.INT", 0.5, 2), ("CLM.STR", "ADM.RPT", 0.5, 3),
    ("CLM.STR", "ADM.FWA", 0.4, 3),
)
# first and last hour (UTC), volume and error multiplier
DAILY = ((0, 5, 0.45, 0.8), (6, 9, 0.90, 0.9), (10, 16, 1.15, 1.0), (17, 22, 1.90, 1.9), (23, 23, 0.80, 1.1))
# key, error rate, window in seconds, least lines; other keys take the default
THRESHOLDS = (("PAY.BNK", 0.10, 30, 5), ("ADM.AUD", 0.01, 10, 20), ("PAY.EXP", 0.05, 10, 20))
DEFAULT_THRESHOLD = (0.05, 10, 20)
# scenario, kind, key, target, ramp in seconds, hold in seconds
SCENARIOS = (
    ("db_timeout_spike", "rate", "CLM.STR", 0.25, 5.0, 90.0),
    ("slow_degradation", "rate", "ELG.MBR", 0.08, 600.0, 300.0),
    ("bad_rule_deploy", "mix", "CLM.EDT", 0.55, 0.0, 300.0),
    ("new_error_after_deploy", "mix", "PRV.CRD", 1.0, 0.0, 300.0),
    ("upstream_cascade", "rate", "ELG.MBR", 0.20, 2.0, 120.0),
    ("service_silent", "silence", "PAY.BNK", 0.0, 0.0, 120.0),
    ("nightly_batch_surge", "volume", "PAY.EXP", 20.0, 0.0, 60.0),
    ("brute_force_login", "mix", "ADM.AUT", 1.0, 0.0, 180.0),
)
SUCCESS = "00000"


class ConfigError(ValueError):
    """A vocabulary that contradicts itself."""


@dataclass(frozen=True)
class Vocabulary:
    """Rows of the dimension tables; every component key is SERVICE.COMPONENT."""

    components: tuple = COMPONENTS
    codes: tuple = CODES
    edges: tuple = EDGES
    services: dict = field(default_factory=lambda: dict(SERVICES))

    def __post_init__(self) -> None:
        names = [c[0] for c in self.components]
        keys = {self.key(n) for n in names}
        if len(set(names)) != len(names) or len({c[0] for c in self.codes}) != len(self.codes):
            raise ConfigError("a component or code occurs twice")
        if any(c[1] not in self.services for c in self.components):
            raise ConfigError("a component has an unknown service")
        if any(len(c[0]) != 3 or len(c[1]) != 3 for c in self.components) or any(len(c[0]) != 5 or c[0][0] not in "EWF" for c in self.codes):
            raise ConfigError("a name has the wrong width")
        if any(not (0 <= c[4] <= 1 and 0 <= c[5] <= 1 and 0 < c[2] <= 1) for c in self.components):
            raise ConfigError("a rate or criticality is out of range")
        if any(c[1] not in names for c in self.codes) or any(a not in keys or b not in keys for a, b, *_ in self.edges):
            raise ConfigError("a code or edge has an unknown component")

    def key(self, component: str) -> str:
        return next((f"{c[1]}.{c[0]}" for c in self.components if c[0] == component), "")

    def component_rows(self) -> list[tuple]:
        """idx, key, service, component, criticality, rps, err, warn, p50_ms."""
        return [(i, f"{s}.{c}", s, c, crit, float(rps), err, warn, float(p50)) for i, (c, s, crit, rps, err, warn, p50, _) in enumerate(self.components)]

    def code_rows(self) -> list[tuple]:
        """code, key, level, weight, place among the codes of its key and level, their number, latency_min_ms, template."""
        groups: dict[tuple[str, str], list[str]] = {}
        for code, component, *_ in self.codes:
            groups.setdefault((component, code[0]), []).append(code)
        return [(code, self.key(c), code[0], w, (g := groups[c, code[0]]).index(code), len(g), least, text) for code, c, w, _, least, text in self.codes]


DEFAULT = Vocabulary()
COMPONENT_SCHEMA = "idx int, key string, service string, component string, criticality double, rps double, err double, warn double, p50_ms double"
CODE_SCHEMA = "code string, key string, level string, weight double, place int, places int, latency_min_ms int, template string"


def components(spark: SparkSession, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    return spark.createDataFrame(vocabulary.component_rows(), COMPONENT_SCHEMA)


def codes(spark: SparkSession, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    return spark.createDataFrame(vocabulary.code_rows(), CODE_SCHEMA)


def edges(spark: SparkSession, vocabulary: Vocabulary = DEFAULT) -> DataFrame:
    return spark.createDataFrame([(a, b, float(c), float(lag)) for a, b, c, lag in vocabulary.edges], "src string, dst string, coupling double, lag_s double")


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(r), w, n) for k, r, w, n in THRESHOLDS], "key string, limit_rate double, window_s int, min_n int")


def daily_curve(spark: SparkSession) -> DataFrame:
    """hour, volume, err: one row for each hour of the day."""
    return spark.createDataFrame([(h, v, e) for a, b, v, e in DAILY for h in range(a, b + 1)], "hour int, volume double, err_mult double")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCENARIOS), "scenario string, kind string, key string, target double, ramp_s double, hold_s double")


def load_yaml(catalog_path: str, platform_path: str) -> Vocabulary:
    """A vocabulary from a catalog file (services, components, codes) and a platform file (rates,
    dependencies). Needs a YAML reader."""
    import yaml

    with open(catalog_path, encoding="utf-8") as f:
        catalog = yaml.safe_load(f)
    with open(platform_path, encoding="utf-8") as f:
        platform = yaml.safe_load(f)
    try:
        rows = tuple(
            (c, v["service"], float(v["criticality"]), p["rps"], float(p["err"]), float(p.get("warn", 0.0)), p["p50_ms"], v["name"])
            for c, v in catalog["components"].items()
            for p in [platform["components"][c]]
        )
        code_rows = tuple((c, v["component"], float(v["weight"]), v["latency_ms"], v["latency_min_ms"], v["template"]) for c, v in catalog["codes"].items())
        edge_rows = tuple((e["from"], e["to"], float(e["coupling"]), e["lag_s"]) for e in platform["propagation"])
        services = {k: v["name"] for k, v in catalog["services"].items()}
    except KeyError as e:
        raise ConfigError(f"{e} is missing") from e
    return Vocabulary(rows, code_rows, edge_rows, services)
