"""Parameter sets.

``CLINICAL`` holds the values a user of the original clinical cohort study
passes (ICU-style tables); ``FIXTURE`` holds the values used with the
driver's generated tables (orders/customer/events roles, see FIXTURES.md).
Operators take every one of these as an argument; nothing below is read
implicitly.
"""

from __future__ import annotations

import inspect

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the original study's constants for equal results.
# Stated as plain text, in their natural order.
# ---------------------------------------------------------------------------
CLINICAL = {
    "excluded_units": ["NICU"],
    "return_window_days": 30,
    "min_age_years": 18,
    "year_days_milli": 365242,  # 365.242 days per year
    "discharge_buckets": {
        "SNF": ["SNF", "REHAB/DISTINCT PART HOSP", "DISC-TRAN CANCER/CHLDRN H",
                "LONG TERM CARE HOSPITAL", "DISC-TRAN TO FEDERAL HC",
                "HOSPICE-MEDICAL FACILITY", "SHORT TERM HOSPITAL", "DISCH-TRAN TO PSYCH HOSP",
                "HOSPICE-HOME", "ICF", "SNF-MEDICAID ONLY CERTIF"],
        "HOME": ["HOME WITH HOME IV PROVIDR", "HOME HEALTH CARE", "HOME"],
    },
    "discharge_default": "OTHER",
    "code_flags": {
        "congestive_heart_failure": ["39891", "4280", "4281", "42820", "42821", "42822", "42823",
                                     "42830", "42831", "42832", "42833", "42840", "42841", "42842",
                                     "42843", "4289"],
        "copd": ["490", "4910", "4911", "4912", "49120", "49121", "49122", "4918", "4919", "4920",
                 "4928", "494", "4940", "4941", "496"],
        "renal_failure": ["5800", "5804", "58081", "58089", "5809", "5810", "5811", "5812", "5813",
                          "58181", "58189", "5819", "5820", "5821", "5822", "5824", "58281", "58289",
                          "5829", "5830", "5831", "5832", "5834", "5836", "5837", "58381", "58389",
                          "5839", "587"],
        "diabetes": ["24901", "24910", "24911", "24920", "24921", "24930", "24931", "24940", "24941",
                     "24950", "24951", "24960", "24961", "24970", "24971", "24980", "24981", "24990",
                     "24991", "25002", "25003", "25010", "25011", "25012", "25013", "25020", "25021",
                     "25022", "25023", "25030", "25031", "25032", "25033", "25040", "25041", "25042",
                     "25043", "25050", "25051", "25052", "25053", "25060", "25061", "25062", "25063",
                     "25070", "25071", "25072", "25073", "25080", "25081", "25082", "25083", "25090",
                     "25091", "25092", "25093", "24900", "25000", "25001", "7902", "79021", "79022",
                     "79029", "7915", "7916", "V4585", "V5391", "V6546"],
    },
    # the renal set is compared on lower(code)
    "lowercase_flags": ["renal_failure"],
    "title_flag": ("cancer", "malignant"),  # lower(title) LIKE '%malignant'
    "lab_item_ids": [50862, 50878, 50885, 50963, 50809, 50971, 50983, 50863, 50820, 50821,
                     50818, 51275, 51237, 51144, 51222, 51265, 51300, 51002, 50912, 50911],
    "chart_item_ids": [220180, 220179, 646, 220210, 220045, 198],
    "ethnicity_rules": [("ASIAN", "ASIAN"), ("WHITE", "WHITE"), ("HISPANIC", "HISPANIC/LATINO"),
                        ("BLACK", "BLACK")],
    "ethnicity_default": "OTHER",
    "age_bands": [(10, 30, 1), (30, 50, 2), (50, 70, 3)],  # right-closed, else 4
    "los_bands": [(1, 15, 1), (16, 30, 2), (31, 45, 3)],  # right-closed, else 4
    "band_default": 4,
    "sequence_hours": 48,
    "z_limit": 4,
    "test_fraction": 0.2,
    "validation_fraction": 0.125,
    "bootstrap_replicates": 100,
    "embedding_size": 50,
    "clusters": 4,
    "cluster_starts": 30,
    "cluster_tol": 0.0001,
}
# ---------------------------------------------------------------------------

# Values for the generated test tables (roles in FIXTURES.md §2).  A code is
# a part key as text; flag i takes a run of consecutive keys, as many as the
# clinical set of the same name holds.
FIXTURE_LAB_TYPES = ["click", "view", "purchase"]
FIXTURE_CHART_TYPES = ["error", "signup"]
FIXTURE_EVENT_TYPES = FIXTURE_LAB_TYPES + FIXTURE_CHART_TYPES


def _key_runs(sets: dict[str, list[str]], first_key: int = 1) -> dict[str, list[str]]:
    out, k = {}, first_key
    for name, codes in sets.items():
        out[name] = [str(i) for i in range(k, k + len(codes))]
        k += len(codes)
    return out


def only(fn, params: dict) -> dict:
    """The entries of a parameter set that ``fn`` takes by keyword; ``fn`` itself stays strict."""
    takes = inspect.signature(fn).parameters
    return {k: v for k, v in params.items() if k in takes and takes[k].kind is inspect.Parameter.KEYWORD_ONLY}


FIXTURE = {
    "excluded_units": ["5-LOW"],
    "return_window_days": 30,
    "min_age_years": 18,
    "year_days_milli": 365242,
    "discharge_buckets": {"SNF": ["F"], "HOME": ["O"]},
    "discharge_default": "OTHER",
    "code_flags": _key_runs(CLINICAL["code_flags"]),
    "lowercase_flags": ["renal_failure"],
    "title_flag": ("cancer", "ring"),
    # item id = 10 * position of the event type + event_id % 3
    "lab_item_ids": [0, 1, 2, 10, 11, 12, 20, 21],  # item 22 is left out on purpose
    "chart_item_ids": [30, 31, 32, 40, 41, 42],
    "ethnicity_rules": [("URGENT", "URGENT"), ("HIGH", "HIGH"), ("MEDIUM", "MEDIUM"),
                        ("LOW", "LOW")],
    "ethnicity_default": "OTHER",
    "age_bands": [(10, 30, 1), (30, 50, 2), (50, 70, 3)],
    "los_bands": [(1, 15, 1), (16, 30, 2), (31, 45, 3)],
    "band_default": 4,
    "sequence_hours": 48,
    "z_limit": 4,
}
