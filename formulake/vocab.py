"""Word lists, patterns, ranges and constants the results depend on."""

# Column names of the formulation tables.
FORMULATION_CORE = [
    "reference_doi", "lipid_molar_ratio", "ionizable_lipid_name",
    "encapsulation_efficiency_percent_std_num", "np_ratio_std_num", "buffer_ph_std_num",
    "cargo_type", "helper_lipid_name", "peg_lipid_name", "particle_size_nm_std_num",
    "pdi_std_num", "zeta_potential_mv_std_num", "ionizable_lipid_smiles", "source_note",
]
REQUIRED = ["reference_doi", "lipid_molar_ratio", "encapsulation_efficiency_percent_std_num"]
OUTCOME = "encapsulation_efficiency_percent_std_num"

# Loose header spellings and the canonical column each one stands for.
HEADER_ALIASES = {
    "doi": "reference_doi",
    "reference": "reference_doi",
    "paper": "reference_doi",
    "ratio": "lipid_molar_ratio",
    "molar_ratio": "lipid_molar_ratio",
    "lipid_ratio": "lipid_molar_ratio",
    "composition": "lipid_molar_ratio",
    "ee": "encapsulation_efficiency_percent_std_num",
    "ee_percent": "encapsulation_efficiency_percent_std_num",
    "encapsulation": "encapsulation_efficiency_percent_std_num",
    "encapsulation_efficiency": "encapsulation_efficiency_percent_std_num",
    "ionizable": "ionizable_lipid_name",
    "ionizable_lipid": "ionizable_lipid_name",
    "lipid": "ionizable_lipid_name",
    "smiles": "ionizable_lipid_smiles",
    "helper": "helper_lipid_name",
    "peg": "peg_lipid_name",
    "cargo": "cargo_type",
    "payload": "cargo_type",
    "np": "np_ratio_std_num",
    "n_p": "np_ratio_std_num",
    "np_ratio": "np_ratio_std_num",
    "ph": "buffer_ph_std_num",
    "buffer_ph": "buffer_ph_std_num",
    "size": "particle_size_nm_std_num",
    "diameter": "particle_size_nm_std_num",
    "pdi": "pdi_std_num",
    "zeta": "zeta_potential_mv_std_num",
}

# Markers of a missing outcome.
MISSING_MARKS = ["", "nan", "n.d.", "nd", "na", "none", "-", "--"]

# Patterns of the outcome text parser.
OUTCOME_NOTE = r"(?i)\((?:n\s*=\s*\d+|SD|SEM|s\.?d\.?)[^)]*\)"
OUTCOME_ERROR = r"\s*±\s*[\d.]+.*$"
OUTCOME_RANGE = r"(?i)^\s*[~≈>≥<≤]?\s*([\d.]+)\s*(?:-|–|—|to|~)\s*([\d.]+)"

# Physical ranges per value column.
RANGES = {
    "ee": (0.0, 100.0),
    "np": (0.5, 50.0),
    "ph": (3.0, 9.0),
    "size": (20.0, 500.0),
    "pdi": (0.0, 1.0),
    "zeta": (-60.0, 60.0),
}

# Names.
UNNAMED = "Custom lipid"
GENERIC_NAMES = [
    "ionizable lipid", "ionisable lipid", "cationic lipid", "ionizable lipids",
    "novel lipid", "lipid", "lipids", "custom", "custom lipid", "unnamed",
    "not specified", "n/a", "na", "none", "unknown", "test lipid",
    "lead lipid", "candidate lipid", "amino lipid", "ionizable amino lipid",
]
NOT_IONIZABLE = [
    "dspc", "dope", "dopc", "dppc", "dspe", "cholesterol", "chol",
    "lecithin", "phosphatidylcholine", "dmg-peg2000", "dmg-peg", "peg-dmg",
    "alc-0159", "c14-peg2000", "peg-lipid", "dmpe-peg2000", "peg-c-dma",
    "mrna", "sirna", "dna", "pdna", "aso", "sarna", "circrna",
]
ION_CANON = {
    "SM-102": ["sm102", "sm-102"],
    "ALC-0315": ["alc0315", "alc-0315"],
    "DLin-MC3-DMA": ["mc3", "mc-3", "dlinmc3dma", "dlin-mc3-dma", "dlinmc3"],
    "DLin-KC2-DMA": ["kc2", "kc-2", "dlin-kc2-dma", "dlinkc2dma"],
    "C12-200": ["c12200", "c12-200"],
    "DODAP": ["dodap"],
    "DOTAP": ["dotap"],
    "DLin-DMA": ["dlindma"],
    "Lipid 5": ["lipid5", "lipid 5"],
    "306Oi10": ["306oi10"],
    "9A1P9": ["9a1p9"],
}
PEG_CANON = {
    "dmg-peg": "DMG-PEG2000",
    "peg-dmg": "DMG-PEG2000",
    "dmg-peg2k": "DMG-PEG2000",
    "dmg-peg 2000": "DMG-PEG2000",
    "peg2000-dmg": "DMG-PEG2000",
    "c14-peg 2000": "C14-PEG2000",
}

# Component dictionaries used to read article text.
IONIZABLE = [
    "DLin-MC3-DMA", "DLin-KC2-DMA", "DLinDMA", "SM-102", "SM102", "ALC-0315", "ALC0315",
    "C12-200", "cKK-E12", "OF-02", "306Oi10", "5A2-SC8", "Lipid 5", "L319", "TT3", "9A1P9",
    "FTT5", "BAMEA-O16B", "YSK05", "CL4H6", "306O13", "A6", "98N12-5", "7C1", "DODAP", "DODMA",
]
HELPER = ["DSPC", "DOPE", "POPC", "DPPC", "DOPC", "DSPE", "SOPC", "egg PC", "ESM"]
PEG_LIPID = [
    "DMG-PEG2000", "DMG-PEG 2000", "DMG-PEG", "ALC-0159", "ALC0159", "PEG-DMG", "PEG2000-DMG",
    "DSPE-PEG2000", "DSPE-PEG", "C16-PEG2000", "PEG-DSG", "PEG-c-DMA", "PEG-DMPE",
]
CHOLESTEROL = ["cholesterol", "chol ", "chol."]
ROLES = ["ionizable", "helper", "cholesterol", "peg"]

# Cargo words of article text, first class wins.
CARGO_WORDS = {
    "mRNA": ["mrna", "messenger rna", "modrna", "nucleoside-modified rna"],
    "siRNA": ["sirna", "small interfering"],
    "saRNA": ["sarna", "self-amplifying", "replicon"],
    "pDNA": ["pdna", "plasmid dna", "plasmid"],
    "ASO": ["antisense oligo", "aso "],
    "circRNA": ["circrna", "circular rna"],
}
# Cargo classes of claims, first matching pattern wins, else "other".
CARGO_CLASSES = [
    ("saRNA", r"sarna|self-ampl|srrna"),
    ("circRNA", r"circrna"),
    ("siRNA", r"sirna"),
    ("mRNA", r"sgrna|crispr|cas9|abe "),
    ("mRNA", r"mrna|spike|il-12|il-33|exotoxin"),
    ("ASO", r"antisense|\baso\b"),
    ("DNA", r"pdna|plasmid|dsrna|odn|poly|^dna$"),
    ("protein", r"protein|peptide|ovalbumin|epo|antibody|enzyme|albumin|rnp"),
    ("small molecule",
     r"curcumin|paclitaxel|doxorubicin|dexamethasone|small molecule|drug"),
]
NUCLEIC_CARGO = ["mRNA", "siRNA", "DNA", "ASO", "saRNA", "circRNA"]
CARGO_SPELLINGS = ["mrna", "sirna", "pdna", "sarna", "asomrna", "aso", "circrna", "dna", "rna"]

# Patterns that find mentions in text.
RATIO_MENTION = (
    r"(?<!\d)\d+(?:\.\d+)?\s*[:/;,|-]\s*\d+(?:\.\d+)?"
    r"(?:\s*[:/;,|-]\s*\d+(?:\.\d+)?){2,3}(?!\d)(?!\.\d)"
)
RATIO_TOKEN = (
    r"(?<![\d.])\d{1,3}(?:[.,]\d{1,2})?\s*[:/]\s*\d{1,3}(?:[.,]\d{1,2})?"
    r"(?:\s*[:/]\s*\d{1,3}(?:[.,]\d{1,2})?)?(?:\s*[:/]\s*\d{1,3}(?:[.,]\d{1,2})?)?"
    r"(?:\s*[:/]\s*\d{1,3}(?:[.,]\d{1,2})?)?(?!\d)(?!\.\d)"
)
OUTCOME_MENTION = (
    r"(?i)(?:encapsulation|entrapment|loading|encapsulated|entrapped|EE)"
    r"[^.%]{0,100}?(\d+(?:\.\d+)?)\s*%"
)
OUTCOME_MENTION_BACK = r"(?i)(\d+(?:\.\d+)?)\s*%\s*(?:EE|encapsulation efficiency|encapsulation)"
OUTCOME_MENTION_VERB = (
    r"(?i)(?:encapsulation efficien\w*|EE%?|%\s*EE)\s*(?:\([^)]{0,20}\))?\s*"
    r"(?:of|was|were|is|are|:|=|reached|achiev\w+|up to)\s*"
    r"(?:approximately|about|around|~|>)?\s*(\d{1,3}(?:\.\d+)?)\s*%?"
)
OUTCOME_MENTION_SHORT = r"(?i)(\d{1,3}(?:\.\d+)?)\s*%\s*(?:encapsulation|EE\b)"
OUTCOME_ANCHORED = (
    r"(?i)(?:encapsulation\s+efficienc\w*|\bEE%?\b|entrapment\s+efficienc\w*)"
    r"[^.\n]{0,120}?(\d{1,3}(?:\.\d{1,2})?)\s*%"
)
OUTCOME_NEAR = r"(?i)encapsulation efficien|entrapment efficien|\bEE\b|%\s*EE"
OUTCOME_GENERAL = (
    r"(?i)\b(typically|generally|usually|often|exceed\w*|greater than|more than|"
    r"close to 100|well-optimized)\b"
)
OUTCOME_FORMULA = (
    r"(?i)(calculated as|determined as|according to the (?:following )?(?:formula|equation)|"
    r"EE\s*\(?%\)?\s*=|=\s*\(|×\s*100|\\times|\\frac|following equation|as follows)"
)
OUTCOME_BOUND = (
    r"(?i)(above|below|over|under|at least|up to|approximately|about|around|~|"
    r"−\s*\d|-\s*\d{2}\s*%)"
)
APPROXIMATE = r"(?i)(?:>|≥|above|over|exceed\w*|approximately|about|~|nearly|almost)"
PROCESS_PATTERNS = {
    "np": r"(?i)N\s*/\s*P[^0-9]{0,20}(\d+(?:\.\d+)?)",
    "ph": r"(?i)\bpH[^0-9]{0,20}(\d+(?:\.\d+)?)",
    "size": r"(?i)(?:particle size|diameter|size)[^0-9]{0,30}(\d+(?:\.\d+)?)\s*nm",
    "pdi": r"(?i)\bPDI[^0-9]{0,20}(\d+(?:\.\d+)?)",
    "zeta": r"(?i)(?:zeta|ζ)[^0-9\-+]{0,20}([\-+]?\d+(?:\.\d+)?)\s*mV",
}
DOI_PATTERN = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+[A-Za-z0-9])"
PMCID_PATTERN = r"(?i)\b(PMC\d{4,12})\b"
FIGURE_MARK = r"(?i)(?:Figure|Fig\.)\s*\d+"
TABLE_NUMBER = r"(\d{1,3}(?:\.\d+)?)"
TABLE_SIGNED = r"(-?\d{1,3}(?:\.\d+)?)"
EXCERPT_TABLE_WORDS = r"encapsul|molar|formulation|lipid|composition"

# Header words that give a table column its role.
TABLE_ROLES = {
    "ratio": ["molar ratio", "ratio", "composition", "formulation"],
    "ee": ["encapsulation", "ee (%)", "ee(%)", "ee %", "entrapment"],
    "size": ["size", "diameter", "z-ave"],
    "pdi": ["pdi", "polydispers"],
    "zeta": ["zeta"],
}

# Candidate score parts.
SCORE_BASE = {"text": 0.40, "caption": 0.45, "table": 0.55}

# Error bands of the outcome, best first.
BANDS = [("85+", 85.0, 101.0), ("70-85", 70.0, 85.0), ("50-70", 50.0, 70.0), ("0-50", 0.0, 50.0)]

# Dispersion grades, their thresholds and expected errors.
DISPERSION_EDGES = (1.7, 4.6, 10.3)
DISPERSION_EDGES_LOGIT = (0.25, 1.0, 4.5)
DISPERSION_GRADES = ["high", "medium", "low", "very low"]
DISPERSION_MAE = {"high": 11.5, "medium": 13.0, "low": 14.5, "very low": 19.3}
DISPERSION_SCALE = 2.08
DISPERSION_UNKNOWN = 16.4

# Shrinkage by anchor count, slope break, logit floors.
SHRINK_BY_K = {1: 0.5, 2: 0.75}
SHRINK_DEFAULT = 1.0
SPREAD_LIMIT = 12.0
REFERENCE_PREDICTION = 80.0
PEG_BREAK = 2.5
LOGIT_BASE = 10.0
LOGIT_SHARP = 1.0
LOGIT_MARGIN = 0.4
