"""Names, codes and rules that results depend on, stated as plain data."""

# Source column -> table column, per table.
COLUMN_MAPS = {
    "condition": {
        "_encounterReferenceId": "visit_occurrence_id",
        "code__text": "condition_source_value",
        "id": "condition_occurrence_id",
        "meta__source": "cdm_source",
        "onsetDateTime": "condition_start_datetime",
        "_subjectReferenceId": "person_id",
        "extension___diagnosisType": "condition_status_source_value",
    },
    "procedure": {
        "_encounterReferenceId": "visit_occurrence_id",
        "code__text": "procedure_source_value",
        "id": "procedure_occurrence_id",
        "meta__source": "cdm_source",
        "performedDateTime": "procedure_datetime",
        "_subjectReferenceId": "person_id",
    },
}

# Diagnosis statuses and the weight each one gives a localisation.
STATUS_MAIN = "DP"
STATUS_RELATED = "DR"
STATUS_ASSOCIATED = "DAS"
STATUS_WEIGHTS = {"DP": 3, "DR": 2}
OTHER_STATUS_WEIGHT = 1

# Prefix lengths at which a coded diagnosis matches a listed code.
CODE_PREFIX_LENGTHS = (1, 3, 4, 5, 6, 7)

# Claim-code list columns and the name of the list each one flags.
FLAG_COLUMNS = {
    "Liste_1": "list_1",
    "Radioth": "list_1_radiotherapy",
    "Liste_2": "list_2",
    "Liste_3": "list_3",
    "Liste_4_D": "list_4d",
    "Liste_4_A": "list_4a",
}

# Texts with a meaning in the cohort rules.
NO_LOCALISATION = "Absence de localisation primitive"
INCOMPLETE_STAY = "hospitalisation incomplète"
NOTE_STATUS_ACTIVE = "Actif"
NOTE_CLASS_MEETING = "CR-RCP"
MIN_NOTE_LENGTH = 30

# The five knowledge labelling functions.
KNOWLEDGE_LFS = ["lf_ccam", "lf_icd10", "lf_note_md", "lf_imaging_md", "lf_drugs"]

# Oncology treatment types and their SNOMED CT procedure ids.
TREATMENT_SCTIDS = {
    "Chimiothérapie": 367336001,
    "Thérapie ciblée": 1255831008,
    "Immunothérapie": 76334006,
    "Médicaments antihormonaux utilisés en oncologie": 169413002,
}
# Drug list column -> normalised column, keyed by label type.
DRUG_NAME_COLUMNS = {
    "atc": ("atcnm_e", "normalized_atc"),
    "commercial": ("medicament", "normalized_commercial_drug"),
    "active_substance": ("substance_active", "normalized_active_substance"),
}

# Label hierarchy, applied in order (children, parent).
HIERARCHY_RULES = [
    (["TEP scan"], "Imagerie de médecine nucléaire"),
    (
        [
            "TEP scan",
            "TDM TAP (CT-scan)",
            "Échographie",
            "IRM",
            "Mammographie",
            "Radiographie simple",
            "Imagerie de médecine nucléaire",
        ],
        "Imagerie médicale",
    ),
    (["Coloscopie", "Endoscopie digestive haute"], "Endoscopie digestive"),
    (
        ["Endoscopie digestive", "Endoscopie digestive haute", "Coloscopie", "Fibroscopie bronchique"],
        "Endoscopie",
    ),
    (["Biopsie"], "Examen anatomopathologique"),
]

# Sampling defaults (characters, probability floor).
PROXIMITY_SCALE = 500
PROXIMITY_FLOOR = 1e-5

# FHIR security label and coding system.
SECURITY_SYSTEM = "http://terminology.hl7.org/CodeSystem/v3-ObservationValue"
SECURITY_CODE = "AIAST"
SECURITY_DISPLAY = "Artificial Intelligence asserted"
SNOMED_SYSTEM = "https://www.snomed.org/"

# Order of the model columns of the metrics table, and the two averaged ones.
METRICS_TABLE_ORDER = [
    "Rule based",
    "Medgemma-27b",
    "Qwen3-8b",
    "LLM Average",
    "Fully supervised",
    "All tasks",
    "All tasks on Medgemma vote",
    "Task specific",
]
AVERAGED_MODELS = ("Medgemma-27b", "Qwen3-8b")
AVERAGE_NAME = "LLM Average"
TASK_SPECIFIC = "task specific"
