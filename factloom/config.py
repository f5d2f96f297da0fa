"""Thresholds and vocabularies. All of them are parameters of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Gates of the merge and limits of the collectors."""

    auto_update: float = 85.0
    review: float = 60.0
    contact_auto_min: float = 90.0
    accept_identity: int = 65
    uncertain_identity: int = 45
    min_hosts: int = 5
    search_limit: int = 12
    as_of_year: int = 2024
    price_in: float = 3.0
    price_out: float = 15.0


SETTINGS = Settings()

# Access levels from weakest to strongest, with reliability and cap.
ACCESS_LEVELS = [
    ("vendor_reference", 0.2, 40),
    ("search_snippets", 0.5, 65),
    ("third_party_directory", 0.78, 75),
    ("job_posting", 0.75, 75),
    ("social_profile", 0.7, 75),
    ("staff_profile", 0.9, 75),
    ("live_official_site", 0.95, 95),
    ("user_provided_ground_truth", 1.0, 100),
]
# Networks that count as major, by substring.
MAJOR_NETWORKS = [
    "sbc", "southern baptist", "assemblies of god", "nazarene", "methodist", "presbyterian", "lutheran", "acts 29", "arc",
    "send network", "newthing", "converge", "efca", "foursquare", "vineyard", "exponential", "cmn",
]
# Page categories in order of precedence, with the substrings that tell them.
PAGE_CATEGORIES = [
    ("about", ["about", "who-we-are", "our-story", "whoweare"]),
    ("staff", ["staff", "team", "our-team"]),
    ("leadership", ["leadership", "leaders", "elders", "pastors"]),
    ("beliefs", ["belief", "what-we-believe", "values", "doctrine", "mission-vision"]),
    ("contact", ["contact", "connect", "visit", "plan-a-visit", "plan-your-visit"]),
    ("locations", ["location", "campus", "campuses", "times", "service-times"]),
    ("ministries", ["ministr", "groups", "discipleship"]),
    ("missions", ["mission", "outreach", "global", "serve"]),
    ("church-planting", ["plant", "church-planting", "multiply", "multiplication"]),
    ("residency", ["residency", "internship", "cohort", "school-of-ministry", "training"]),
    ("partners", ["partner", "network", "affiliation"]),
]
# Header synonyms of the roster, by field.
HEADER_SYNONYMS = {
    "rowid": ["s.no", "sno", "s no", "id", "row", "row id", "#"],
    "name": ["organization name", "church name", "name", "org name"],
    "parent": ["parent organization name", "parent organization", "parent", "district", "region", "network"],
    "address1": ["address 1", "address1", "address", "street", "street address"],
    "address2": ["address 2", "address2", "suite", "unit"],
    "city": ["city"],
    "state": ["state", "province", "st"],
    "zip": ["postal code", "zip", "zip code", "zipcode", "postcode"],
    "country": ["country"],
    "phone": ["phone number", "phone", "telephone", "tel"],
    "email": ["email", "e-mail", "email address"],
    "website": ["website", "url", "web", "web site", "site"],
    "urlname": ["url name", "urlname", "alt name", "alternate name"],
    "language": ["language", "languages", "primary language"],
}
# Words that don't tell one organisation from another.
STOP_WORDS = [
    "church", "of", "the", "nazarene", "community", "fellowship", "a", "at", "in", "and", "first", "new", "iglesia", "el", "la",
    "de", "ministries", "ministry",
]
# State codes.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC "
    "SD TN TX UT VT VA WA WV WI WY DC"
).split()
# Hosts of directories and profiles, by substring.
DIRECTORY_HOSTS = [
    "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "yelp.com", "yellowpages.com", "mapquest.com",
    "tripadvisor.com", "churchfinder.com", "uschurch.org", "find-a-church", "wikipedia.org", "linkedin.com", "ein.org",
    "causeiq.com", "tiktok.com", "joinmychurch.com", "faithstreet.com", "churchangel.com", "alluschurches.com",
    "unitedstateschurches.com", "christianchurchsearch.com", "taxexemptworld.com", "guidestar.org", "propublica.org", "manta.com",
]
# Structured field names and the facts that they are folded into.
STRUCTURED_FACTS = {
    "email": "office_email",
    "phone": "office_phone",
    "lead_pastor": "lead_pastor",
    "executive_pastor": "executive_pastor",
    "operations_leader": "operations_leader",
    "communications_leader": "communications_leader",
    "staff_count": "staff_count",
}
# Fields with numbers in the master table.
NUMERIC_FIELDS = [
    "staff_count", "campus_count", "weekend_services_count", "attendance_estimate", "attendance_min", "attendance_max",
    "attendance_confidence", "influence_score", "fit_score", "multiplication_score", "church_planting_activity",
    "leadership_development_score", "digital_reach_score", "verification_score",
]
# Calibration fields with type, relative tolerance and whether they describe the run.
CALIBRATION_FIELDS = [
    ("church_name", "string", None, False), ("city", "string", None, False), ("state", "string", None, False),
    ("lead_pastor", "string", None, False), ("lead_pastor_role", "string", None, False), ("executive_pastor", "string", None, False),
    ("operations_leader", "string", None, False), ("communications_leader", "string", None, False), ("office_email", "string", None, False),
    ("office_phone", "string", None, False), ("denomination", "string", None, False), ("multi_site", "bool", None, False),
    ("campus_count", "number", 0.0, False), ("lifecycle_stage", "enum", None, False), ("founded_year", "number", 0.01, False),
    ("years_active", "number", 0.06, False), ("avg_weekly_attendance", "number", 0.35, False), ("online_attendance_estimate", "number", 0.45, False),
    ("staff_count", "number", 0.4, False), ("annual_budget", "number", 0.5, False), ("church_app_status", "enum", None, False),
    ("app_provider", "string", None, False), ("livestream_present", "bool", None, False), ("youtube_present", "bool", None, False),
    ("instagram_present", "bool", None, False), ("facebook_present", "bool", None, False), ("instagram_followers", "number", 0.2, False),
    ("facebook_followers", "number", 0.2, False), ("online_giving_present", "bool", None, False), ("change_readiness_score", "number", 0.25, False),
    ("digital_maturity_score", "number", 0.25, False), ("growth_orientation_score", "number", 0.25, False), ("staff_depth_score", "number", 0.25, False),
    ("evidence_access_level", "string", None, True), ("identity_contamination_flag", "bool", None, True),
]
