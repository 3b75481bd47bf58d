"""Rule tables.

FIXED VALUES: the lists and tables below must equal the reference's values for results to
match.  They are stated plainly, in their natural order; callers may pass their own copies.
"""

from __future__ import annotations

# --- FIXED VALUES: paid-source rules -------------------------------------------------------
PAID_TERMS = [
    "paid", "cpc", "ppc", "google ads", "adwords", "facebook", "instagram", "meta", "linkedin",
    "bing", "microsoft ads", "tiktok", "display", "paid search", "paid social", "atra",
    "klient boost", "klientboost",
]
PAID_SEARCH_TERMS = ["paid search", "google ads", "adwords", "cpc", "ppc", "bing", "microsoft ads"]
PAID_SOCIAL_TERMS = ["paid social", "facebook", "instagram", "meta", "linkedin", "tiktok"]

# --- FIXED VALUES: vendor rules ------------------------------------------------------------
VENDOR_ALIASES = [
    ("Atra", ["atra", "atra analytics"]),
    ("KlientBoost", ["klient boost", "klientboost"]),
    ("Google", ["google", "google ads", "adwords"]),
    ("Meta", ["facebook", "meta", "instagram"]),
    ("LinkedIn", ["linkedin"]),
    ("Microsoft/Bing", ["bing", "microsoft ads"]),
]
VENDOR_FIELD_TERMS = ["vendor", "partner", "agency", "referral", "source", "campaign"]
PREFERRED_SOURCE_FIELDS = [
    "source", "source_group", "utm_source", "utm_medium", "utm_campaign", "campaigns",
    "hs_analytics_source", "hs_analytics_source_data_1", "hs_analytics_source_data_2",
    "hs_latest_source", "hs_latest_source_data_1", "hs_latest_source_data_2", "paid_lead_list",
]

# --- FIXED VALUES: degree tuition table (level, per credit, credits, total, annual, years, months, note)
DEGREE_TUITION = [
    ("Certificate", 585, 18, 10530, 10530, 0.5, 6, ""),
    ("Associate", 585, 60, 35100, 14040, 2.0, 24, ""),
    ("Bachelor", 585, 120, 70200, 14040, 4.0, 48, ""),
    ("Master", 841, 39, 32799, 15138, 2.0, 24, ""),
    ("Doctoral", 884, 61, 53924, 10608, 4.0, 48, "confirm actual expected duration with institution policy"),
]
TUITION_SOURCE_LABEL = "published_tuition_config"

# --- FIXED VALUES: lead scoring terms ------------------------------------------------------
QUALIFIED_TERMS = ["mql", "sql", "qualified", "opportunity"]
SCORING_DEAD_TERMS = [
    "closed lost", "closedlost", "disqualified", "unqualified", "not interested", "bad fit",
    "invalid", "junk", "duplicate",
]
ARCHIVE_TERMS = ["duplicate", "junk", "invalid", "disqualified", "not interested", "closed lost", "closedlost"]

# --- FIXED VALUES: revenue status pattern -------------------------------------------------
REVENUE_ENROLLED_PATTERN = "enrolled|ea signed|active|registered|accepted"
REVENUE_LOST_PATTERN = "lost|denied|rejected"

# --- FIXED VALUES: pipeline health --------------------------------------------------------
PIPELINE_STATUS_COLUMNS = [
    "enrollment_status", "final_lead_status", "lead_status", "lifecycle_stage",
    "latest_deal_stage", "deal_stage",
]
PIPELINE_DEAD_TERMS = ["dead", "lost", "disqualified", "unqualified", "not interested", "invalid", "junk", "duplicate"]
PIPELINE_ENROLLED_TERMS = ["enrolled", "ea signed", "active student", "registered", "accepted", "closed won", "won"]
PIPELINE_DEAD_COLUMNS = ["final_lead_status", "lead_status", "lifecycle_stage", "latest_deal_stage", "deal_stage"]
CLEANUP_INVALID_PATTERN = "invalid|junk|duplicate|test|spam"

# --- FIXED VALUES: cohorts ----------------------------------------------------------------
COHORT_ENROLLED_PATTERN = "enroll|active|signed|registered|accepted"
SEASON_START_MONTH = [("spring", 1), ("summer", 5), ("fall", 8), ("autumn", 8), ("winter", 12)]

# --- FIXED VALUES: uploaded leads ---------------------------------------------------------
BAD_LEAD_STATUSES = ["dead lead", "do not contact", "duplicate lead", "app submitted - unqualified"]
CONTACTED_STATUSES = [
    "outreach attempt 1", "outreach attempt 2", "outreach attempt 3", "outreach attempt 4",
    "responded", "warm lead", "hot lead", "cold lead", "qualified meeting set",
    "interviewed - app ready", "interviewed - not ready", "app submitted - qualified",
    "app submitted - unqualified", "future applicant", "enrolled",
]
EXPLICIT_CONTACT_COLUMNS = ["contacted", "contacted_progressed", "is_contacted"]
IDENTITY_COLUMNS = ["record_id", "hs_object_id", "id", "email"]

UNKNOWN_SOURCE = "Unmapped"
SOURCE_PRIORITY = [
    "paid_lead_list", "organic_lead_list", "campaign", "utm_campaign", "utm_source", "utm_medium",
    "event_attended", "source", "enrollment_source", "hs_latest_source_data_1",
    "hs_latest_source_data_2", "hs_analytics_source_data_1", "hs_analytics_source_data_2",
    "hs_latest_source", "hs_analytics_source",
]
PAID_HINTS = [
    "ad", "ads", "agent", "atra", "clearance jobs", "eddie", "eddie leads", "ebg", "falcon",
    "hiregi", "kara", "karyl", "leads", "nathen", "oby", "paid", "project falcon", "vendor",
]
ORGANIC_HINTS = ["alumni", "direct", "event", "organic", "referral", "website"]
SOURCE_ALIASES = [
    ("(blank)", UNKNOWN_SOURCE), ("nan", UNKNOWN_SOURCE), ("none", UNKNOWN_SOURCE),
    ("website", "Website"), ("referral", "Referral"), ("alumni", "Alumni"),
    ("falcon", "Project Falcon"), ("project falcon", "Project Falcon"),
    ("eddie leads", "Eddie Leads"), ("kara leads", "Kara Leads"), ("karyl leads", "Karyl Leads"),
    ("hiregi", "HireGI"), ("ebg", "EBG"), ("atra", "ATRA"),
]

# --- FIXED VALUES: terms ------------------------------------------------------------------
SEASON_LABELS = [("SP", "Spring"), ("SU", "Summer"), ("FA", "Fall")]

# --- FIXED VALUES: activity types -----------------------------------------------------------
ACTIVITY_TYPE_LABELS = [("calls", "Call"), ("emails", "Email"), ("meetings", "Meeting"), ("notes", "Note"), ("tasks", "Task")]
ACTIVITY_DESCRIPTION_FIELDS = [
    ("calls", ["hs_call_title", "hs_call_body"]),
    ("emails", ["hs_email_subject", "hs_email_text", "hs_email_html"]),
    ("meetings", ["hs_meeting_title", "hs_meeting_body"]),
    ("notes", ["hs_note_body"]),
    ("tasks", ["hs_task_subject", "hs_task_body"]),
]
ACTIVITY_OUTCOME_FIELDS = [
    ("calls", ["hs_call_disposition", "hs_call_status"]),
    ("emails", ["hs_email_status", "hs_email_direction"]),
    ("meetings", ["hs_meeting_outcome"]),
    ("tasks", ["hs_task_status", "hs_task_priority"]),
]
DETAILED_EVENT_TYPES = ["Call", "Email", "Meeting", "Note", "Task"]

# --- FIXED VALUES: contact / deal logical-field fallbacks -------------------------------------
CONTACT_FALLBACKS = {
    "contact_id": ["hs_object_id", "id"],
    "contact_created_at": ["createdate", "createdAt"],
    "contact_owner_id": ["hubspot_owner_id"],
    "owner_assigned_date": ["hubspot_owner_assigneddate"],
    "first_name": ["firstname"],
    "last_name": ["lastname"],
    "full_name": ["hs_full_name_or_email", "fullname"],
    "student_name": ["hs_full_name_or_email"],
    "last_activity_date": ["notes_last_updated"],
    "next_activity_date": ["notes_next_activity_date"],
    "last_sales_activity_timestamp": ["hs_last_sales_activity_timestamp"],
    "time_to_first_engagement": ["hs_time_to_first_engagement"],
    "first_outreach_date": ["hs_first_outreach_date"],
    "first_engagement_date": ["hs_sa_first_engagement_date"],
    "first_activity_date": ["hs_first_outreach_date", "hs_sa_first_engagement_date"],
    "first_engagement_description": ["hs_sa_first_engagement_descr"],
    "first_engagement_type": ["hs_sa_first_engagement_object_type"],
    "final_lead_status": ["final_lead_status"],
    "application_status": ["application_status"],
    "application_date": ["application_date", "application_submitted_date"],
    "enrollment_date": ["enrollment_date", "enrolled_date"],
    "source": ["source", "hs_analytics_source", "hs_latest_source"],
    "campaign": ["utm_campaign", "campaign", "campaigns"],
    "number_of_sales_activities": ["num_notes"],
    "program_total_tuition": ["standard_tuition_total", "total_tuition_and_fees"],
}
CONTACT_TEXT_FIELDS = [
    "email", "phone", "lifecycle_stage", "lead_status", "final_lead_status", "original_source",
    "latest_source", "source", "source_detail", "utm_source", "utm_medium", "utm_campaign",
    "campaign", "vendor", "program", "degree_level", "degree_program", "intended_program",
    "student_type", "enrollment_status", "enrollment_date", "application_date", "start_term",
    "cohort", "campus", "modality", "last_activity_date", "first_activity_date",
    "next_activity_date", "num_notes", "number_of_sales_activities",
    "last_sales_activity_timestamp", "time_to_first_engagement", "first_outreach_date",
    "first_engagement_date", "first_engagement_description", "first_engagement_type",
    "application_status",
]
CONTACT_DATE_FIELDS = [
    "enrollment_date", "application_date", "last_activity_date", "first_activity_date",
    "next_activity_date", "last_sales_activity_timestamp", "first_outreach_date",
    "first_engagement_date",
]
DEAL_FALLBACKS = {
    "deal_id": ["hs_object_id", "id"],
    "deal_created_at": ["createdate", "createdAt"],
    "deal_owner_id": ["hubspot_owner_id"],
    "deal_owner_assigned_date": ["hubspot_owner_assigneddate"],
    "closed_won_date": ["hs_closed_won_date"],
    "deal_amount": ["amount", "revenue"],
    "revenue": ["amount"],
    "is_closed_won": ["hs_is_closed_won"],
    "is_closed": ["hs_is_closed"],
}

# Logical -> physical mapping used for the CRM view (a profile of the landed tables picks it).
DEFAULT_MAPPING = {
    "contact": {
        "contact_id": "hs_object_id",
        "contact_created_at": "createdate",
        "contact_owner_id": "hubspot_owner_id",
        "email": "email",
        "phone": "phone",
        "lifecycle_stage": "lifecyclestage",
        "lead_status": "hs_lead_status",
        "utm_source": "utm_source",
        "utm_medium": "utm_medium",
        "utm_campaign": "utm_campaign",
        "program": "program",
        "degree_level": "degree_level",
        "enrollment_status": "enrollment_status",
        "enrollment_date": "enrollment_date",
        "application_date": "application_date",
        "start_term": "session_start",
        "cohort": "cohort",
        "campus": "campus_location",
        "modality": "modality",
        "num_notes": "num_notes",
    },
    "deal": {
        "deal_id": "hs_object_id",
        "deal_created_at": "createdate",
        "deal_owner_id": "hubspot_owner_id",
        "deal_stage": "dealstage",
        "pipeline": "pipeline",
        "close_date": "closedate",
        "deal_amount": "amount",
    },
}

# --- FIXED VALUES: field profiling preferred candidates (logical field -> physical names) ----------
DASHBOARD_FIELDS = {
    "contact": {
        "contact_id": ["hs_object_id"],
        "contact_created_at": ["createdate"],
        "contact_owner_id": ["hubspot_owner_id"],
        "first_name": ["firstname", "first_name"],
        "last_name": ["lastname", "last_name"],
        "full_name": ["hs_full_name_or_email", "fullname", "full_name", "name"],
        "email": ["email"],
        "phone": ["phone", "mobilephone"],
        "lifecycle_stage": ["lifecyclestage"],
        "lead_status": ["hs_lead_status"],
        "final_lead_status": ["final_lead_status"],
        "original_source": ["hs_analytics_source"],
        "latest_source": ["hs_latest_source"],
        "source": ["source", "hs_analytics_source", "hs_latest_source"],
        "source_detail": ["hs_analytics_source_data_1", "hs_analytics_source_data_2", "hs_latest_source_data_1",
                          "hs_latest_source_data_2"],
        "utm_source": ["utm_source"],
        "utm_medium": ["utm_medium"],
        "utm_campaign": ["utm_campaign"],
        "campaign": ["utm_campaign", "campaign", "campaigns", "hs_analytics_source_data_2"],
        "vendor": ["vendor", "partner", "agency", "referral_partner", "paid_lead_vendor", "paid_lead_list"],
        "program": ["program", "program_of_interest", "degree_program", "academic_program"],
        "degree_level": ["degree_level", "desired_degree_level"],
        "degree_program": ["degree_program", "degree", "program"],
        "intended_program": ["intended_program", "program_interest", "degreeprogram_interest"],
        "student_type": ["student_type", "secondary_student_type", "transfer_student"],
        "enrollment_status": ["enrollment_status", "hs_prospecting_agent_enrollment_status"],
        "enrollment_date": ["enrollment_date", "enrolled_date", "student_enrollment_date", "start_date"],
        "application_date": ["application_date", "application_submitted_date", "applied_date"],
        "start_term": ["start_term", "session_start", "term_start", "start_date"],
        "cohort": ["cohort", "cohort_term", "cohort_start"],
        "campus": ["campus", "campus_location", "work_campus"],
        "modality": ["modality", "learning_modality", "delivery_modality"],
        "program_total_tuition": ["standard_tuition_total", "total_tuition_and_fees", "total_tuition",
                                  "program_tuition_total", "tuition_total", "estimated_total_tuition"],
        "last_activity_date": ["notes_last_updated", "hs_lastmodifieddate", "hs_sales_email_last_replied",
                               "hs_last_sales_activity_timestamp"],
        "owner_assigned_date": ["hubspot_owner_assigneddate"],
        "first_activity_date": ["hs_first_outreach_date", "hs_sa_first_engagement_date", "hs_time_to_first_engagement"],
        "next_activity_date": ["hs_next_activity_date"],
        "number_of_sales_activities": ["num_notes", "hs_sales_email_clicks", "hs_sales_email_opens"],
        "time_to_first_engagement": ["hs_time_to_first_engagement"],
    },
    "deal": {
        "deal_id": ["hs_object_id"],
        "deal_created_at": ["createdate"],
        "deal_owner_id": ["hubspot_owner_id"],
        "deal_owner_assigned_date": ["hubspot_owner_assigneddate"],
        "deal_stage": ["dealstage"],
        "pipeline": ["pipeline"],
        "close_date": ["closedate"],
        "closed_won_date": ["hs_closed_won_date"],
        "deal_amount": ["amount", "revenue", "tuition", "net_revenue", "program_revenue"],
        "revenue": ["amount", "revenue", "tuition", "net_revenue", "program_revenue"],
        "is_closed_won": ["hs_is_closed_won"],
        "is_closed": ["hs_is_closed"],
    },
}
SEARCH_HINTS = {
    "phone": ["phone", "mobile"],
    "first_name": ["first", "name"],
    "last_name": ["last", "name"],
    "full_name": ["full", "name"],
    "source_detail": ["source", "detail"],
    "source": ["source"],
    "campaign": ["campaign", "utm"],
    "vendor": ["vendor", "partner", "agency", "referral", "source", "campaign"],
    "program": ["program", "degree", "academic", "interest"],
    "degree_level": ["degree", "level"],
    "degree_program": ["degree", "program", "major", "academic"],
    "intended_program": ["program", "degree", "major", "concentration", "academic", "interest"],
    "student_type": ["student", "type"],
    "enrollment_status": ["enrolled", "enrollment", "status", "student"],
    "enrollment_date": ["enrolled", "enrollment", "date"],
    "application_date": ["application", "applied", "date"],
    "start_term": ["term", "start", "session"],
    "cohort": ["cohort"],
    "campus": ["campus"],
    "modality": ["modality"],
    "program_total_tuition": ["tuition", "total"],
    "last_activity_date": ["last", "activity", "modified", "reply"],
    "owner_assigned_date": ["owner", "assigned", "date"],
    "first_activity_date": ["first", "activity", "engagement", "outreach"],
    "next_activity_date": ["next", "activity"],
    "number_of_sales_activities": ["sales", "activity", "notes"],
    "time_to_first_engagement": ["time", "first", "engagement"],
    "deal_amount": ["amount", "revenue", "tuition"],
    "revenue": ["amount", "revenue", "tuition"],
    "lead_status": ["lead", "status"],
    "lifecycle_stage": ["lifecycle", "stage"],
}

# --- FIXED VALUES: text jobs ----------------------------------------------------------------------
DATA_LINE_KEYWORDS = r"(enroll|lead|applicant|start|budget|revenue|goal|source|udr|summer|week|pace|conversion)"
PRICE_LINE_PATTERNS = [
    ("Certificate", r"Certificate Programs\s+\$([\d,]+)\s+(\d+)\s+\$([\d,]+)\s+\$([\d,]+)"),
    ("Associate", r"Associate Degree\s+\$([\d,]+)\s+(\d+)\s+\$([\d,]+)\s+\$([\d,]+)"),
    ("Bachelor", r"Bachelor'?s Degree\s+\$([\d,]+)\s+(\d+)\s+\$([\d,]+)\s+\$([\d,]+)"),
    ("Master", r"Master'?s Degree Programs\s+\$([\d,]+)\s+(\d+)\s+\$([\d,]+)\s+\$([\d,]+)"),
    ("Doctoral", r"Doctoral Degree Programs\s+\$([\d,]+)\s+(\d+)\s+\$([\d,]+)\s+\$([\d,]+)"),
]
HTML_BLOCK_TAG_PATTERN = r"(?i)<(br|p|div|li|tr|h[1-6])[^>]*>"

# --- FIXED VALUES: privacy --------------------------------------------------------------------------
PII_COLUMNS = ["first_name", "last_name", "email", "phone_number", "student", "notes", "sender"]
# FIXED VALUES: what a published table loses, and whose labels are replaced or kept.
PUBLISHED_DROP_COLUMNS = ["first_name", "last_name", "email", "phone_number", "record_id", "contact_owner_id", "id",
                          "hs_object_id", "student", "notes", "sender"]
OWNER_LABEL_COLUMNS = ["contact_owner", "udr", "budget_name", "normalized_budget_name"]
SOURCE_LABEL_COLUMNS = ["source", "normalized_source", "paid_lead_list", "organic_lead_list", "event_attended", "campaign",
                        "utm_source", "utm_campaign", "utm_medium"]
PUBLIC_KEEP_VALUES = ["", "unmapped", "unknown", "missing", "nan", "none", "(blank)", "total", "starts", "start%"]
# FIXED VALUES: raw lead headings and the logical columns they feed.
LEAD_HEADINGS = {
    "hs_object_id": "record_id", "firstname": "first_name", "lastname": "last_name", "hs_lead_status": "lead_status",
    "lifecyclestage": "lifecycle_stage", "phone": "phone_number", "hubspot_owner_id": "contact_owner_id",
    "hs_last_sales_activity_timestamp": "last_activity_date", "notes_last_updated": "last_activity_date",
    "createdate": "create_date", "program": "degree",
}

# --- FIXED VALUES: student journeys (columns, labels and sentences that reports show) ------------------
JOURNEY_FACT_COLUMNS = [
    "contact_id", "student_name", "full_name", "first_name", "last_name", "email", "phone", "salesman_name",
    "owner_assigned_date", "contact_created_at", "first_activity_date", "last_activity_date", "next_activity_date",
    "number_of_sales_activities", "time_to_first_engagement", "application_date", "enrollment_date", "program",
    "degree_level", "cohort", "start_term", "campus", "modality", "vendor", "campaign", "source", "source_group",
    "paid_lead_flag", "lead_status", "final_lead_status", "enrollment_status", "lead_temperature", "deal_created_at",
    "deal_stage", "close_date", "actual_revenue", "estimated_enrolled_revenue", "potential_revenue",
]
PROFILE_FIELDS = [
    ("student_name", "Name"), ("email", "Email"), ("phone", "Phone"), ("salesman_name", "Contact owner / salesman"),
    ("lifecycle_stage", "Lifecycle stage"), ("lead_status", "Lead status"), ("final_lead_status", "Final lead status"),
    ("source_group", "Source group"), ("paid_vendor", "Vendor"), ("utm_campaign", "Campaign"),
    ("paid_lead_flag", "Paid lead flag"), ("program", "Program"), ("degree_level", "Degree level"), ("cohort", "Cohort"),
    ("campus", "Campus"), ("modality", "Modality"), ("estimated_total_tuition", "Estimated tuition"),
    ("actual_revenue", "Actual revenue"), ("potential_revenue", "Potential revenue"),
]
# contact date column, event label, description
CONTACT_EVENTS = [
    ("contact_created_at", "Contact created", "HubSpot contact record created"),
    ("owner_assigned_date", "Owner assigned", "Contact owner assigned"),
    ("first_outreach_date", "First outreach", "First outreach date from HubSpot summary"),
    ("first_engagement_date", "First engagement", "First engagement date from HubSpot summary"),
    ("application_date", "Application", "Application date"),
    ("enrollment_date", "Enrollment", "Enrollment date"),
    ("last_sales_activity_timestamp", "Last sales activity", "Last sales activity timestamp"),
    ("last_activity_date", "Last activity", "Last activity date"),
    ("next_activity_date", "Next activity", "Next scheduled activity"),
]
DEAL_EVENTS = {"created": "Deal created", "close": "Deal close date", "won": "Closed won", "lost": "Closed lost"}
NEXT_ACTIONS = {
    "hot": "Call today and schedule the next enrollment step.",
    "open deal": "Follow up on the open deal and confirm next action.",
    "untouched": "Make first contact attempt and log the outcome.",
    "idle": "Re-engage with a call and email sequence.",
    "else": "Continue normal follow-up cadence.",
}
# --- FIXED VALUES: spellings of a term (season code and half) -------------------------------------------
TERM_HEADER_PATTERN = r"^(SP|SU|FA)-?([12])(?:-?([AG]))?$"
TERM_CODE_PATTERN = r"^(SP|SU|FA)([12])$"
TERM_NAME_PATTERN = r"^(SPRING|SUMMER|FALL)\s*([12])$"
