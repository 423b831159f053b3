"""Scoring weights, thresholds, look-up tables and patterns."""

# Mechanism class labels.
CLASS_FREE = "DSB_FREE_TRANSEST_RECOMBINASE"
CLASS_NUCLEASE = "DSB_NUCLEASE"
CLASS_UNKNOWN = "UNCLASSIFIED"

# Score axes and their weights under each profile.
AXES = ("S_DSB", "S_Spec", "S_Cargo", "S_Deliv", "S_Immuno", "S_Prog", "S_Mature")
PROFILE_V010 = {
    "S_DSB": 0.25,
    "S_Spec": 0.10,
    "S_Cargo": 0.20,
    "S_Deliv": 0.15,
    "S_Immuno": 0.10,
    "S_Prog": 0.15,
    "S_Mature": 0.05,
}
PROFILE_V012 = {
    "S_DSB": 0.24,
    "S_Spec": 0.14,
    "S_Cargo": 0.19,
    "S_Deliv": 0.19,
    "S_Immuno": 0.09,
    "S_Prog": 0.05,
    "S_Mature": 0.05,
    "S_Energy": 0.05,
}
PROFILES = {"v010": PROFILE_V010, "v012": PROFILE_V012}
USE_CASE = "human_therapeutic_aav_insertion"

# Axis defaults used when a catalog lacks the whole column.
RESCORE_DEFAULTS = {
    "S_DSB": 1.0,
    "S_Spec": 0.9891,
    "S_Cargo": 1.0,
    "S_Deliv": 0.94,
    "S_Immuno": 0.7594,
    "S_Prog": 1.0,
    "S_Mature": 0.0,
    "S_Energy": 1.0,
}

# Score thresholds of the reference editor.
LOCKPOINT_VERBATIM = 0.929
LOCKPOINT_CALIBRATED = 0.9255
LOCKPOINT_CORRECTED = 0.954
LOCKPOINT_V012 = 0.957

# Axis rules.
BASELINE_IMMUNO = 0.7594
BASELINE_IMMUNO_REMEASURED = 0.7243
BASELINE_MATURITY = 0.792
LOAD_SCALE = 253.5
BASELINE_LOAD_CLASS_1 = 15
BASELINE_LOAD_CLASS_2 = 92
DENSITY_SCALE = 0.35
MATURITY_IDENTITY = 0.80

# Source funnel gates.
GATE_PROBABILITY = 0.85
GATE_CONFIDENCE = 0.80
GATE_LENGTH = (200, 400)
GATE_PER_GENUS = 5
GATE_GLOBAL_PLDDT = 70.0
GATE_SITE_PLDDT = 75.0
GATE_NOVELTY = 0.30
GATE_E_VALUE = 1e-10
DOMAIN_FAMILIES = ("PF01548", "PF02371")
KNOWN_MEMBERS = ("A0A2X3M8B0", "A0A2X3M8B1")

# Triage gates and stability limits.
TRIAGE_PLDDT = 50.0
TRIAGE_DDG = 5.0
DDG_WARN = 3.0
DDG_STABILISING = -0.5
PTM_MIN = 0.5
SIZE_RANGE = (250, 1200)
IDENTITY_RANGE = (0.50, 0.75)
RMSD_MAX = 1.5

# Residue window weights in hundredths, and window rules (length, mean threshold in hundredths).
WINDOW_WEIGHTS = {
    "A": 20, "C": 15, "D": 25, "E": 35, "F": 85, "G": 10, "H": 50, "I": 65, "K": 40, "L": 75,
    "M": 55, "N": 30, "P": 10, "Q": 30, "R": 45, "S": 20, "T": 25, "V": 45, "W": 90, "Y": 80,
}
WINDOW_WEIGHT_OTHER = 30
WINDOW_CLASS_1 = (9, 43)
WINDOW_CLASS_2 = (15, 38)

# Residue masses and the polar residue set.
RESIDUE_MASS = {
    "G": 57, "A": 71, "V": 99, "L": 113, "I": 113, "P": 97, "F": 147, "W": 186, "M": 131, "S": 87,
    "T": 101, "C": 103, "Y": 163, "H": 137, "D": 115, "E": 129, "N": 114, "Q": 128, "K": 128, "R": 156,
}
RESIDUE_MASS_OTHER = 115
POLAR_RESIDUES = "RKDENQHST"

# Substitution scan alphabet, surface residues, frozen and catalytic positions, search budget.
SCAN_ALPHABET = "ACDEFHIKLMNQRSTVWY"
SURFACE_RESIDUES = "KREDQNSTHYLVIMFWY"
CATALYTIC_POSITIONS = (11, 60, 102, 105, 241)
CATALYTIC_LENGTH = 342
# Positions that no substitution may touch.
FROZEN_POSITIONS = (
    9, 10, 11, 12, 13, 58, 59, 60, 61, 62, 100, 101, 102, 103, 104, 105, 106, 239, 240, 241, 242, 243, 111,
    112, 113, 114, 115, 116, 117, 118, 119, 120, 121, 122, 123, 124, 125, 126, 127, 128, 129, 130, 135, 136,
    137, 138, 139, 140, 141, 142, 143, 144, 145, 146, 147, 148, 149, 150,
)
SINGLE_COST_CAP = 3.0
# Substitution cost (base, polarity change, mass change per unit of mass) and its cap.
MUTATION_BASE = 0.3
MUTATION_POLARITY = 0.8
MUTATION_MASS_UNIT = 30.0
MUTATION_MASS_WEIGHT = 0.5
MUTATION_CAP = 5.0
# Length score (bounds, and the losses up to each bound).
LENGTH_SHORT = 260.0
LENGTH_MIDDLE = 900.0
LENGTH_LONG = 1200.0
LENGTH_LOSS_SHORT = 0.2
LENGTH_LOSS_MIDDLE = 0.35
LENGTH_LEFT_MIDDLE = 0.65
# Parts of ids that tell the strategy, and the form of chimera ids.
ID_SWAP = "A_"
ID_REDESIGN = "D0"
ID_REDESIGN_LETTER = "D"
ID_REDESIGN_TOOL = "PROTMPNN"
ID_REDESIGN_PARENT = "_IS621_"
ID_TARGETED = "DEIMM"
CHIMERA_ID = "A_%03d_%s_%s_%s"

# Human preferred codons.
CODONS = {
    "A": "GCC", "R": "AGG", "N": "AAC", "D": "GAC", "C": "TGC", "Q": "CAG", "E": "GAG", "G": "GGC",
    "H": "CAC", "I": "ATC", "L": "CTG", "K": "AAG", "M": "ATG", "F": "TTC", "P": "CCC", "S": "AGC",
    "T": "ACC", "W": "TGG", "Y": "TAC", "V": "GTG", "*": "TGA",
}
CODON_UNKNOWN = "NNN"
KOZAK = "GCCACC"
STOP_CODON = "TGA"

# Restriction enzyme recognition sites.
RESTRICTION_SITES = {
    "EcoRI": "GAATTC",
    "BamHI": "GGATCC",
    "HindIII": "AAGCTT",
    "NotI": "GCGGCCGC",
    "XhoI": "CTCGAG",
    "NheI": "GCTAGC",
    "XbaI": "TCTAGA",
    "SalI": "GTCGAC",
}

# Pair distances between catalytic residues, in angstrom, by reference structure.
GEOMETRY_TOLERANCE = 1.5
GEOMETRY_CONFIDENCE = 50.0
GEOMETRY_RESIDUES = {"IS621": (11, 60, 102, 105, 241), "Cre": (324,), "Bxb1": (12,)}
GEOMETRY_DISTANCES = {
    "IS621": (
        (11, 60, 22.1), (11, 102, 18.4), (11, 105, 16.9), (11, 241, 42.3), (60, 102, 9.8),
        (60, 105, 11.5), (60, 241, 35.7), (102, 105, 3.8), (102, 241, 28.6), (105, 241, 27.1),
    ),
}

# Binder prediction alleles and rank thresholds.
ALLELES_CLASS_1 = ("HLA-A02:01", "HLA-A01:01", "HLA-B07:02", "HLA-B44:02")
ALLELES_CLASS_2 = ("DRB1_0101", "DRB1_0301", "DRB1_0401")
RANK_CLASS_1 = 0.5
RANK_CLASS_2 = 10.0

# Chimera modules (name, scaffold, first residue, last residue), cores, RNA modules and linkers.
MODULES = (
    ("RuvC_fold_DEDD", "IS621", 1, 110),
    ("bRNA_binding_loop", "IS621", 110, 150),
    ("IS621_bRNA_extended", "IS621", 100, 260),
    ("Tnp_serine_C_term", "IS621", 150, 260),
    ("loxP_HTH", "Cre", 30, 100),
    ("catalytic_tyrosine_compact", "Cre", 200, 343),
    ("catalytic_tyrosine", "Lambda_Int", 150, 356),
    ("attL_attR_recognition_HTH", "Lambda_Int", 1, 75),
    ("omega_RNA_binding", "IscB", 1, 200),
    ("catalytic_serine_recombinase", "Bxb1", 10, 100),
    ("attP_attB_binding_domain", "Bxb1", 220, 500),
    ("phiC31_serine_catalytic", "phiC31", 1, 140),
    ("phiC31_attP_attB_compact", "phiC31", 460, 613),
    ("Cas12k_compact_RNP", "CAST_VK", 1, 600),
)
# Catalytic residues in scaffold numbering, and families, of the modules that have them.
MODULE_SITES = {
    "RuvC_fold_DEDD": (11, 60, 102, 105),
    "Tnp_serine_C_term": (241,),
    "catalytic_tyrosine_compact": (324,),
    "catalytic_tyrosine": (342,),
    "catalytic_serine_recombinase": (12,),
    "phiC31_serine_catalytic": (12,),
}
MODULE_FAMILIES = {
    "RuvC_fold_DEDD": "PF01548",
    "Tnp_serine_C_term": "PF02371",
    "catalytic_tyrosine": "PF02899",
    "catalytic_serine_recombinase": "PF07508",
    "phiC31_serine_catalytic": "PF07508",
}
# Scaffolds (id, accession, structure, score, class, composite, length, modules, carve-out modules).
SCAFFOLDS = (
    ("IS621", "A0A2X3M8B0", "8WT6", 0.929, "B3_Programmable_Recombinase", True, 304,
     ("RuvC_fold_DEDD", "Tnp_serine_C_term", "bRNA_binding_loop"), ()),
    ("IS621_2", "REQUIRES_REPLACEMENT", None, 0.900, "B3_Programmable_Recombinase", True, None, ("bRNA_binding_loop_v2",), ()),
    ("Lambda_Int", "P03700", "1Z19", 0.823, "B4_Tyrosine_Recombinase", False, 356,
     ("catalytic_tyrosine", "attL_attR_recognition_HTH", "integrase_HU_IHF_binding"), ()),
    ("CAST_IF", "A0A656A320", None, 0.800, "B2_CAST_Integrase", False, 715, ("cascade_RNP", "TnsB_DDE_atypical"), ()),
    ("Cre", "P06956", "1CRX", 0.798, "B4_Tyrosine_Recombinase", False, 343, ("loxP_HTH", "catalytic_tyrosine_compact"), ()),
    ("eePASSIGE_v2", "<inherits_eePASSIGE>", None, 0.797, "B5_Serine_Recombinase", False, None, ("large_serine_engineered",), ()),
    ("Bxb1", "Q9B086", "9IU2", 0.788, "B5_Serine_Recombinase", False, 500,
     ("catalytic_serine_recombinase", "attP_attB_binding_DNA_binding_domain"), ()),
    ("phiC31", "Q9T221", None, 0.785, "B5_Serine_Recombinase", False, 613, ("phiC31_serine_catalytic", "phiC31_attP_attB_compact"), ()),
    ("IscB", "K9VH02", None, 0.784, "N5_RNA_Guided_Nuclease", False, 400, ("omega_RNA_binding",), ()),
    ("CAST_VK", "A0A8M0FGU0", "7N3O", 0.756, "B2_CAST_Integrase", False, 600, ("Cas12k_compact_RNP", "TnsB_TnsC_TniQ_quartet"), ()),
    ("MmeFz2", "REQUIRES_STEP7", None, None, "N2_Fanzor_OMEGA", False, None, (), ("TnpB_compact_scaffold",)),
    ("TwinPE", "TWINPE_FUSION", None, 0.38, "N4_Editor_Fusion", False, None, (), ("pegRNA_encoded_payload_delivery",)),
)
CORES = (
    ("IS621_full_composite", ("RuvC_fold_DEDD", "Tnp_serine_C_term")),
    ("IS621_RuvC_only", ("RuvC_fold_DEDD",)),
    ("Bxb1_serine_compact", ("catalytic_serine_recombinase",)),
    ("Lambda_Int_tyrosine", ("catalytic_tyrosine_compact",)),
    ("phiC31_serine", ("phiC31_serine_catalytic",)),
)
RNA_MODULES = (
    ("IS621_bRNA", "IS621_bRNA_extended"),
    ("IscB_omega", "omega_RNA_binding"),
    ("Cas12k_crRNA", "Cas12k_compact_RNP"),
)
LINKERS = {
    "rigid": "EAAAKEAAAK",
    "flexible_short": "GGGGSGGGGS",
    "flexible_long": "GGGGSGGGGSGGGGSGGGGS",
    "natural_IS_family": "QRSAEELNREL",
}
LINKER_VARIANTS = ("rigid", "flexible_short")
REPEATED_PAIR = ("IS621_full_composite", "IS621_bRNA_extended")
GUIDE_RULES = (
    (("IS621", "bRNA"), "ACCTGTACCGAGGGCCTGTA"),
    (("omega", "IscB"), "GGCTGTGTGGAGAACGATCC"),
    (("Cas12k", "CAST", "crRNA"), "GTTCATTTCGGTAATTATGG"),
)
GUIDE_OTHER = "NNNNNNNNNNNNNNNNNNNN"
LINKER_BAND = {
    "GS": "30-60 (flexible; low pLDDT expected and acceptable)",
    "EAAAK": "50-75 (rigid helix; moderate pLDDT)",
}
LINKER_UNITS = {"GS": ("GGGGS", 4), "EAAAK": ("EAAAK", 5)}

# Identifier patterns and renamed parents.
STRATEGIES = ("A", "B", "C", "D")
REDESIGN_PATTERN = r"(?i)^D\d+_IS621_ProtMPNN_"
DEFAULT_PARENT = "IS621"
RENAMED_PARENTS = {"IS622": "ISCro4"}
CATALOG_ALIASES = {"accession": "uniprot_acc", "length": "protein_length_aa", "sequence": "protein_sequence"}

# Status texts, strategy names and notes written into result tables.
FLAG_PASS = "PASS"
FLAG_REVIEW = "UNCLASSIFIED_MANUAL_REVIEW"
FLAG_DISCARD = "DSB_NUCLEASE_DISCARD"
SCORE_METHOD = "local_axis_implementations"
STRATEGY_SWAP = "A_domain_swap"
STRATEGY_ORTHOLOG = "B_ortholog_discovery"
STRATEGY_TARGETED = "C_deimm"
STRATEGY_VARIANT = "C_deimmunization"
MIN_IMMUNO_GAIN = 0.10
STRUCTURE_DEFERRED = "DEFERRED_STEP12"
SWAP_NOTE = "anti_mode_collapse: replaced rank-%d %s with %s"
UNKNOWN_NAME = "Unknown"

# Hypotheses, in order, and the wording of the roll-up.
HYPOTHESES = (
    ("H1", "count of designs above the lockpoint", "n_beating >= 5"),
    ("H2", "one design with full cargo and high delivery", "n_satisfying >= 1"),
    ("H3", "best gain over the baseline", "delta >= 0.10"),
    ("H4", "survivors of all gates", "n_survivors >= 10"),
    ("H5", "distinct sources in the top five", "n_distinct >= 3"),
)
# How each hypothesis is judged, the query that judges it, why it matters and what to look at when it fails.
PREDICTION_NOTES = {
    "H1": ("count the triaged designs whose score is above the lockpoint", "V1_hypothesis_count_above",
           "the strongest natural editor is the baseline to beat", "compare axis by axis, by strategy, and list the nearest misses"),
    "H2": ("look for a triaged design with both axes at their limits", "V2_hypothesis_existence", "large cargo and easy delivery seldom meet", ""),
    "H3": ("subtract the baseline from the best variant's axis value", "V3_hypothesis_best_gain",
           "less recognition by the immune system at equal stability", "report the gain reached, the mutations spent and the stability left"),
    "H4": ("count the candidates that pass all gates of the funnel", "V4_hypothesis_survivors", "enough candidates must be left to test", ""),
    "H5": ("count distinct strategies among the five best designs", "V5_hypothesis_diversity", "no single strategy should explain the result", ""),
}
# Protospacer, cargo capacity in base pairs and axis values of the scaffolds that state them.
SCAFFOLD_DETAILS = (
    ("IS621", "ACCTGTACCGAGGGCCTGTA", 1000000,
     {"S_DSB": 0.90, "S_Spec": 1.0, "S_Cargo": 1.0, "S_Deliv": 0.9421, "S_Immuno": 0.7594, "S_Prog": 1.0, "S_Mature": 0.792}),
)
# Strategies (id, name, method, target number, gates as name, columns, comparison, value, null rule, required).
STRATEGY_REGISTRY = (
    ("A", "domain swap", "combination of modules", 30, (("size", ("total_aa", "protein_length_aa"), "between", SIZE_RANGE),)),
    ("B", "ortholog discovery", "triage of candidates", 50, (
        ("1", ("composite_prob",), "ge", GATE_PROBABILITY),
        ("2", ("composite",), "true"),
        ("3", ("protein_length_aa",), "between", GATE_LENGTH),
        ("5_global", ("af3_mean_plddt", "mean_plddt"), "ge", GATE_GLOBAL_PLDDT),
        ("6", ("gate_6_distance",), "gt", GATE_NOVELTY, "keep"),
    )),
    ("C", "deimmunization", "substitutions at the surface", 10, (
        ("mutations", ("total_mutations",), "le", 15),
        ("stability", ("predicted_ddg_total", "ddg_kcal_mol"), "le", 8.0),
    )),
    ("D", "backbone redesign", "inverse folding", 25, (
        ("rmsd", ("backbone_rmsd",), "le", 1.5),
        ("identity", ("sequence_identity_to_wt",), "between", (0.50, 0.75)),
    )),
)
ROLLUP_TEXT = {
    "all": "5/5 pre-registered predictions PASS",
    "four_evaluated": "4/4 evaluated predictions PASS, 1 NOT_EVALUABLE",
    "four": "4/5 predictions PASS, 1 FAIL",
    "three": "3/5 predictions PASS",
    "rework": "REWORK FRAMEWORK -- too few predictions verified",
}
RESAMPLING = {"iterations": 1000, "sigma": 0.02, "seed": 42, "top": 5}
