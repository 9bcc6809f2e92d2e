"""Column names and labels shared by the operators."""

# Column spellings found in the yearly grant tables.
TITLE_COLUMN = "ApplicationTitle_TitreDemande"
NAME_CANDIDATES = ("NomineeNameEN_NomCandidatAN", "NomineeName_NomCandidat")
NAME_FRAGMENTS = ("name", "nom")
TITLE_FRAGMENTS = ("title", "titre")
PRIMARY = "PrimaryInstituteEN_InstitutPrincipalAN"
CATEGORIES = "AllResearchCategoriesEN_TousCategoriesRechercheAN"
KEYWORDS = "ApplicationKeywords_MotsClesDemande"
FUNDING_START = "FundingStartDate_DatePremierVersement"
FUNDING_END = "FundingEndDate_DateDernierVersement"

# What a name match brings in, and what stands where nothing was found.
NAME_ENRICHMENT = (PRIMARY, CATEGORIES, KEYWORDS)
NOT_FOUND = "Not Found"

# What a title match brings in: grant column -> outcome column it replaces.
TITLE_ENRICHMENT = {
    PRIMARY: "Primary_Institute",
    CATEGORIES: "Research_Categories",
    FUNDING_START: "Funding_Start",
    FUNDING_END: "Funding_End",
}

# Key of a scored record.
SCORE_KEY = ("Name", "Project_Title", "Competition_CD")
SCORE_COLUMNS = (
    "outcome_data",
    "level_1_score",
    "level_2_score",
    "level_5_score",
    "total_score",
)
