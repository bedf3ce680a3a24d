"""Fixed values that must equal the disclosure format for correct results."""

# --- fixed values: column names of the yearly research-payment files ---
PAYMENT_COLUMN = "Total_Amount_of_Payment_USDollars"
PI_SLOTS = (1, 2, 3, 4, 5)
PI_PREFIX = "Principal_Investigator_"

# Older files name the covered person "Physician_*", newer ones "Covered_Recipient_*".
OLD_LAYOUT = {
    "first": "Physician_First_Name",
    "middle": "Physician_Middle_Name",
    "last": "Physician_Last_Name",
    "npi": "Physician_NPI",
    "profile": "Physician_Profile_ID",
    "specialty": "Physician_Specialty",
}
NEW_LAYOUT = {
    "first": "Covered_Recipient_First_Name",
    "middle": "Covered_Recipient_Middle_Name",
    "last": "Covered_Recipient_Last_Name",
    "npi": "Covered_Recipient_NPI",
    "profile": "Covered_Recipient_Profile_ID",
    "specialty": "Covered_Recipient_Specialty",
}

# --- fixed values: strings a pandas CSV read turns into missing values ---
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: labels used in reports ---
ROLE_COVERED = "Covered Recipient"
ROLE_PI = "Principal Investigator"
SPECIALTY_PI = "Principal Investigator"
UNKNOWN = "Unknown"
ID_TYPE_NPI = "NPI"
ID_TYPE_PROFILE = "Profile ID"
ID_TYPE_MISSING = "Missing"
MISSING_ID_LABEL = "Missing unique identifier"
FILE_NAME_PATTERN = "{year}_rsh_payments.csv"
YEAR_IN_PATH = r"((?:19|20)\d{2})"

# Money is summed exactly; six decimals cover every published amount.
AMOUNT_TYPE = "decimal(38,6)"
