"""Words, names, patterns and defaults that results depend on.

They are data, not logic.  Every operator takes them as parameters whose
defaults are these, so a different domain (clinics, museums, suppliers) only
swaps the lists.
"""

# Failure markers written in-band into the URL column.
NOT_FOUND = "NOT_FOUND"
ERROR_NOT_FOUND = "ERROR_NOT_FOUND"

# A URL cell holding one of these (trimmed, lowercased) still needs work.
PENDING_MARKERS = ("", "nan", "none", "not_found", "error_not_found")

# Output columns, and the headers that already count as the URL column.
URL_COLUMN = "StaffDirectoryURL"
CONFIDENCE_COLUMN = "Confidence"
REASONING_COLUMN = "Reasoning"
URL_COLUMN_ALIASES = (
    "staffdirectoryurl",
    "staff_directory_url",
    "staff_directory_page",
    "staffdirectory",
    "directory_url",
)

# Canonical entity field -> accepted headers, best first.
ENTITY_ALIASES = {
    "name": ("school_name", "name", "school"),
    "district": ("district_name", "district"),
    "county": ("county_name", "county"),
    "city": ("city",),
    "state": ("state",),
}

# CSV cells read as missing (the documented default list of pandas.read_csv).
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Search queries.  Each template is the entity name plus these alternatives;
# the one marked with_district is only used when the district is known.
QUERY_TEMPLATES = (
    {"lead": "name", "clause": '"staff directory"', "any": ("staff directory",)},
    {
        "lead": "name",
        "clause": '("faculty & staff" OR "faculty and staff" OR "staff")',
        "any": ("faculty & staff", "faculty and staff", "staff"),
    },
    {
        "lead": "name",
        "clause": '("our staff" OR "staff list" OR "faculty directory" OR "directory")',
        "any": ("our staff", "staff list", "faculty directory", "directory"),
    },
    {
        "lead": "district",
        "clause": '("staff directory" OR "directory")',
        "any": ("staff directory", "directory"),
    },
)
MAX_QUERIES = 3
MAX_CANDIDATES = 10
MAX_CONTENT_CHARS = 500

# Attempt limits and outcome codes of the fetch log.
SEARCH_ATTEMPTS = 4
MODEL_ATTEMPTS = 3
EMPTY_STATUS = 422
THROTTLED_STATUS = 429
SERVER_ERRORS = (500, 599)
RETRYABLE_ERRORS = ("ReadTimeout", "ConnectError")

# Reasons written beside a result.
REASON_MISSING_NAME = "Missing school name"
REASON_NO_RESULTS = "No search results found"
REASON_NO_RESPONSE = "No response from model"
REASON_MALFORMED = "Extracted from malformed response"
REASON_NO_ELIGIBLE = "No eligible page among the candidates"
MALFORMED_CONFIDENCE = "low"

# First link in running text.
FIRST_URL_PATTERN = r"""https?://[^\s"'>)]+"""

# Page rules (hosts match exactly or as a parent domain).
AGGREGATOR_HOSTS = ("greatschools.org", "niche.com")
SOCIAL_HOSTS = (
    "facebook.com",
    "twitter.com",
    "x.com",
    "instagram.com",
    "linkedin.com",
    "youtube.com",
    "tiktok.com",
)
STAFF_TERM_PATTERN = r"(^|[^a-z])(staff|faculty|directory)([^a-z]|$)"
DIRECTORY_SLUG_PATTERN = r"staff-directory|faculty-staff"
CONTACT_PATTERN = r"contact[-_ ]?us"
ABOUT_PATTERN = r"about[-_ ]?us"
NEWS_PATTERN = r"(^|[^a-z])(news|announcements?)([^a-z]|$)"
CALENDAR_PATTERN = r"(^|[^a-z])calendars?([^a-z]|$)"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
PHONE_PATTERN = r"(\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}"
SPECIFIC_SHARE = 0.5
