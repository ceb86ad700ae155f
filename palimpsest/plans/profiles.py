"""Profiles, entities and the mapping of outside labels: small tables that live on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entities by profile.
BASE_ENTITIES = ("email", "phone", "credit_card", "iban", "us_ssn", "ip_address", "domain", "url")
PLUS_ENTITIES = (*BASE_ENTITIES, "date_time", "location", "person", "street_address", "title")
NER_ENTITIES = ("person", "location", "organization")
PHI_ENTITIES = ("medical_condition", "medication", "patient_id", "provider")

PROFILES = {
    "regex_only": BASE_ENTITIES,
    "deterministic_plus": PLUS_ENTITIES,
    "hybrid_ner": (*BASE_ENTITIES, *NER_ENTITIES),
    "hybrid_gliner_ortex": (*BASE_ENTITIES, *NER_ENTITIES, "date_time", "street_address"),
    "hybrid_gliner_urchade": (*BASE_ENTITIES, *NER_ENTITIES, "date_time", "street_address"),
    "hybrid_gliner_urchade_native": (*BASE_ENTITIES, *NER_ENTITIES, "date_time", "street_address"),
    "phi": (*BASE_ENTITIES, *PHI_ENTITIES),
}
#: Product names of profiles.
PRODUCTS = {"fast": "regex_only", "balanced": "hybrid_ner", "accurate": "hybrid_gliner_urchade"}

#: Outside label to entity.
TAXONOMY = {
    "account_number": "id", "age": "age", "api_key": "api_key", "bank_routing_number": "id", "biometric_identifier": "biometric_identifier", "blood_type": "blood_type", "certificate_license_number": "id",
    "city": "location", "company_name": "organization", "coordinate": "location", "country": "location", "county": "location", "credit_debit_card": "credit_card", "customer_id": "id", "cvv": "credit_card",
    "date": "date_time", "date_of_birth": "date_time", "date_time": "date_time", "device_identifier": "device_identifier", "education_level": "education_level", "email": "email", "employee_id": "id",
    "employment_status": "employment_status", "fax_number": "phone", "first_name": "person", "gender": "gender", "health_plan_beneficiary_number": "patient_id", "http_cookie": "secret", "ipv4": "ip_address", "ipv6": "ip_address",
    "language": "language", "last_name": "person", "license_plate": "vehicle_identifier", "mac_address": "mac_address", "medical_record_number": "patient_id", "national_id": "id", "occupation": "occupation", "password": "password",
    "phone_number": "phone", "pin": "password", "political_view": "political_view", "postcode": "zip_code", "race_ethnicity": "race_ethnicity", "religious_belief": "religious_belief", "sexuality": "sexuality", "ssn": "us_ssn",
    "state": "location", "street_address": "street_address", "swift_bic": "iban", "tax_id": "id", "time": "date_time", "unique_id": "id", "url": "url", "user_name": "username", "vehicle_identifier": "vehicle_identifier",
}


#: Entities that the models of a profile find; without a model's outputs only the rest is found.
MODEL_ENTITIES = {
    "hybrid_ner": NER_ENTITIES,
    "hybrid_gliner_ortex": (*NER_ENTITIES, "date_time", "street_address"),
    "hybrid_gliner_urchade": (*NER_ENTITIES, "date_time", "street_address"),
    "hybrid_gliner_urchade_native": (*NER_ENTITIES, "date_time", "street_address"),
    "phi": PHI_ENTITIES,
}


def profile_of(name: str) -> str:
    """The profile of a profile's or product's name; an unknown name is an error."""
    name = PRODUCTS.get(name, name)
    if name not in PROFILES:
        raise ValueError("unknown profile")
    return name


def entities_of(profile: str) -> tuple[str, ...]:
    return PROFILES[PRODUCTS.get(profile, profile)]


def supported(entity, profile: str):
    """Whether the profile can find the entity, as a column."""
    return entity.isin(*entities_of(profile))


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TAXONOMY.items()), "source_entity string, entity string")


def map_labels(spans: DataFrame, column: str = "source_entity", strict: bool = False) -> DataFrame:
    """spans with ``entity`` by the taxonomy; unknown labels are ``unknown``, or an error if strict. The table is a constant of 55 rows."""
    table = F.broadcast(taxonomy(spans.sparkSession).withColumnRenamed("source_entity", "_label").withColumnRenamed("entity", "_entity"))
    joined = spans.join(table, F.lower(spans[column]) == F.col("_label"), "left").drop("_label")
    missing = F.raise_error(F.lit("unknown entity label")).cast("string") if strict else F.lit("unknown")
    return joined.withColumn("entity", F.coalesce("_entity", missing)).drop("_entity")


def dataset_catalog() -> dict[str, dict]:
    """Known data sets: name to file and pinned SHA-256 (None where the file is not pinned)."""
    return {name: {"path": f"{name}.json", "sha256": None} for name in ("generated_small", "generated_large", "synth_v2", "mock_input_samples", "nemotron_subset")}


def prune_models(requested: tuple[str, ...], models: dict[str, tuple[str, ...]]) -> list[str]:
    """The models that some requested entity needs, in their order."""
    return [name for name, entities in models.items() if set(entities) & set(requested)]
