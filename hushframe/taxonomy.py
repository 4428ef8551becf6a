"""Categories of personal data: their groups, their labels, and the table of both."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Group, category and label of what texts hold.
_TEXT = (
    ("person", "primary_subject_name", "Person"),
    ("person", "other_person_name", "Person"),
    ("person", "gender", "Gender"),
    ("person", "age", "Age"),
    ("person", "religion_ethnicity_cast", "Community"),
    ("person", "sexual_orientation", "Orientation"),
    ("person", "blood_type", "BloodType"),
    ("person", "occupation_designation_education_level", "Occupation"),
    ("location", "country", "Country"),
    ("location", "state_province", "State"),
    ("location", "city_district", "City"),
    ("location", "postal_zip_pin_code", "Postcode"),
    ("location", "street_address", "Address"),
    ("location", "geocode_coordinates", "Geocode"),
    ("date_time", "date_of_birth", "Date"),
    ("date_time", "death_date", "Date"),
    ("date_time", "other_date_time", "Date"),
    ("contact", "phone_mobile", "Phone"),
    ("contact", "fax", "Fax"),
    ("contact", "email", "Email"),
    ("contact", "web_url", "URL"),
    ("uid", "ssn", "SSN"),
    ("uid", "aadhaar_12_digit", "Aadhaar"),
    ("uid", "pan", "PAN"),
    ("uid", "voter_id", "VoterID"),
    ("uid", "passport_no", "Passport"),
    ("uid", "driving_licence_no", "DrivingLicence"),
    ("uid", "national_id", "NationalID"),
    ("uid", "tax_id", "TaxID"),
    ("uid", "mrn_uhid", "MRN"),
    ("uid", "health_plan_beneficiary_no", "HealthPlanID"),
    ("uid", "abha_number_14_digit", "ABHA"),
    ("uid", "abha_address", "ABHAAddress"),
    ("uid", "pmjay_ayushman_id", "AyushmanID"),
    ("uid", "practitioner_reg_no_npi_nmc", "PractitionerReg"),
    ("uid", "bank_account_number", "BankAccount"),
    ("uid", "iban", "IBAN"),
    ("uid", "upi_id", "UPI"),
    ("uid", "insurance_tpa_policy_no", "PolicyNo"),
    ("uid", "other_id", "ID"),
    ("uid", "vehicle_id_licence_plate", "VehicleID"),
    ("device_net", "ip_address", "IPAddress"),
    ("device_net", "device_serial_identifier", "DeviceID"),
    ("device_net", "mac_address", "MACAddress"),
    ("credential", "password", "Password"),
    ("credential", "api_key_token", "APIKey"),
    ("credential", "high_entropy_secret", "Secret"),
    ("entity", "brandname", "Brand"),
)
# What images hold, and the text that marks it.
_VISUAL = (
    ("face_photo", "[FACE]"),
    ("signature", "[SIGNATURE]"),
    ("seal_stamp", "[STAMP]"),
    ("fingerprint_thumb_impression", "[FINGERPRINT]"),
    ("qr_barcode", "[QR]"),
    ("logo", "[LOGO]"),
)
VISUAL_GROUP, NO_GROUP, NO_PLACEHOLDER = "biometric_visual", "unknown", "[REMOVED]"

GROUPS = {category: group for group, category, _ in _TEXT}
LABELS = {category: label for _, category, label in _TEXT}
PLACEHOLDERS = dict(_VISUAL)
TEXT_CATEGORIES, VISUAL_CATEGORIES = tuple(GROUPS), tuple(PLACEHOLDERS)
CATEGORIES = TEXT_CATEGORIES + VISUAL_CATEGORIES


def checked(categories: Iterable[str] | None) -> list[str] | None:
    """The categories asked for; None stands for all. ValueError names those that don't exist."""
    if categories is None:
        return None
    asked = list(categories)
    if odd := [c for c in asked if c not in CATEGORIES]:
        raise ValueError(f"Unknown entity categories: {odd}. Valid categories: {list(CATEGORIES)}")
    return asked


def plain_label(category: str) -> str:
    """The label of one category: as listed, else its parts capitalised."""
    return LABELS.get(category) or "".join(p.capitalize() for p in category.split("_"))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def group_of(category: Column) -> Column:
    """The group of a category column; `unknown` if it is in no list."""
    return F.coalesce(F.try_element_at(_map(GROUPS | dict.fromkeys(VISUAL_CATEGORIES, VISUAL_GROUP)), category), F.lit(NO_GROUP))


def label_of(category: Column) -> Column:
    """The label of a category column, or its parts capitalised."""
    parts = F.transform(F.split(category, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2**31 - 1))))
    return F.coalesce(F.try_element_at(_map(LABELS), category), F.array_join(parts, ""))


def upper_label_of(category: Column) -> Column:
    """The label of a category column in capitals: what is left of `label_of`'s parts then is their letters."""
    return F.upper(F.coalesce(F.try_element_at(_map(LABELS), category), F.replace(category, F.lit("_"), F.lit(""))))


def placeholder_of(category: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(PLACEHOLDERS), category), F.lit(NO_PLACEHOLDER))


def taxonomy(spark: SparkSession) -> DataFrame:
    """(ord, category, l1, label, kind): every category in order, those of texts before those of images."""
    rows = [(i, c, GROUPS[c], LABELS[c], "text") for i, c in enumerate(TEXT_CATEGORIES)]
    rows += [(len(rows) + i, c, VISUAL_GROUP, plain_label(c), "visual") for i, c in enumerate(VISUAL_CATEGORIES)]
    return spark.createDataFrame(rows, "ord int, category string, l1 string, label string, kind string")
