"""Fixed reference values of the financial domain: codes, sections, labels, lexicons, rules' word lists."""

from __future__ import annotations

# --- Fixed values, in their natural order -------------------------------------------------------------------------

#: Codes that a section may hold when values are resolved.
SECTION_CODES = {
    "BILAN_ACTIF": "TOTAL_ACTIF TOTAL_BILAN ACTIFS_IMMOBILISES ACTIF_CIRCULANT STOCKS CLIENTS TRESORERIE_ACTIF CAISSE".split(),
    "BILAN_PASSIF": "TOTAL_PASSIF TOTAL_BILAN FONDS_PROPRES RESULTAT_NET DETTES_FINANCIERES DETTES_BANCAIRES_MLT DETTES_BANCAIRES_CT PASSIF_CIRCULANT FOURNISSEURS COMPTE_COURANT_ASSOCIES TRESORERIE_PASSIF".split(),
    "CPC": "CHIFFRE_AFFAIRES CA_EXPORT RESULTAT_NET RESULTAT_NET_XIII RESULTAT_NET_XVI RESULTAT_EXPLOITATION PRODUITS_EXPLOITATION CHARGES_EXPLOITATION PRODUITS_FINANCIERS CHARGES_FINANCIERES RESULTAT_FINANCIER RESULTAT_COURANT PRODUITS_NON_COURANTS CHARGES_NON_COURANTES RESULTAT_NON_COURANT RESULTAT_AVANT_IMPOT IMPOT_SUR_RESULTATS ACHATS_REVENDUS ACHATS_CONSOMMES AUTRES_CHARGES_EXTERNES CHARGES_INTERETS DOTATIONS_AMORTISSEMENTS PRODUITS_CESSION_IMMOBILISATIONS VALEUR_NETTE_IMMOBILISATIONS_CEDEES CAF".split(),
    "DETAIL_CPC": "REDEVANCES_CREDIT_BAIL AUTRES_CHARGES_EXTERNES AUTRES_CHARGES_EXTERNES_DETAIL".split(),
    "RESULTAT_FISCAL": "RESULTAT_FISCAL REINTEGRATIONS DEDUCTIONS IS_DU COTISATION_MINIMALE REPORT_DEFICITAIRE".split(),
}
#: Codes that also exist for the previous year; all others exist for the current one alone.
TWO_YEAR_CODES = "CHIFFRE_AFFAIRES RESULTAT_NET FONDS_PROPRES TOTAL_ACTIF TOTAL_PASSIF TOTAL_BILAN".split()
PREVIOUS_YEAR_KEY = {c: f"{c}_N1" for c in "CHIFFRE_AFFAIRES RESULTAT_NET TOTAL_BILAN FONDS_PROPRES DETTES_FINANCIERES".split()}
#: Codes of the current year that must stand in one column of their section.
ROLE_OF = {
    "BILAN_ACTIF": ("NET_N", "TOTAL_ACTIF TOTAL_BILAN ACTIFS_IMMOBILISES ACTIF_CIRCULANT STOCKS CLIENTS TRESORERIE_ACTIF".split()),
    "BILAN_PASSIF": ("EXERCICE_N", "TOTAL_PASSIF TOTAL_BILAN FONDS_PROPRES DETTES_FINANCIERES PASSIF_CIRCULANT FOURNISSEURS TRESORERIE_PASSIF RESULTAT_NET".split()),
    "CPC": ("TOTAL_EXERCICE_N", "CHIFFRE_AFFAIRES RESULTAT_NET RESULTAT_NET_XIII RESULTAT_NET_XVI RESULTAT_EXPLOITATION PRODUITS_EXPLOITATION CHARGES_EXPLOITATION PRODUITS_FINANCIERS CHARGES_FINANCIERES RESULTAT_FINANCIER RESULTAT_COURANT PRODUITS_NON_COURANTS CHARGES_NON_COURANTES RESULTAT_NON_COURANT RESULTAT_AVANT_IMPOT IMPOT_SUR_RESULTATS CHARGES_INTERETS ACHATS_REVENDUS ACHATS_CONSOMMES DOTATIONS_AMORTISSEMENTS PRODUITS_CESSION_IMMOBILISATIONS VALEUR_NETTE_IMMOBILISATIONS_CEDEES".split()),
}
NET_RESULT = "RESULTAT_NET RESULTAT_NET_XIII RESULTAT_NET_XVI".split()
NATURE_POINTS = {"GRAND_TOTAL": 400.0, "SECTION_TOTAL": 300.0, "SUBTOTAL": 200.0, "DETAIL": 100.0, "DERIVED_DISPLAYED": 50.0}
#: Sections in which a code earns points.
EXPECTED_SECTIONS = {
    "BILAN_ACTIF": "STOCKS CLIENTS TRESORERIE_ACTIF ACTIF_CIRCULANT ACTIFS_IMMOBILISES TOTAL_ACTIF CAISSE".split(),
    "BILAN_PASSIF": "FOURNISSEURS DETTES_FINANCIERES DETTES_BANCAIRES_MLT DETTES_BANCAIRES_CT COMPTE_COURANT_ASSOCIES FONDS_PROPRES PASSIF_CIRCULANT TRESORERIE_PASSIF TOTAL_PASSIF RESULTAT_NET".split(),
    "CPC": "CHIFFRE_AFFAIRES CA_EXPORT AUTRES_CHARGES_EXTERNES RESULTAT_NET RESULTAT_NET_XIII RESULTAT_NET_XVI CHARGES_INTERETS REDEVANCES_CREDIT_BAIL".split(),
    "DETAIL_CPC": "AUTRES_CHARGES_EXTERNES REDEVANCES_CREDIT_BAIL".split(),
}
#: Wordings that earn points, by code.
LABEL_HINTS = {
    "CLIENTS": ["clients et comptes rattaches"], "FOURNISSEURS": ["fournisseurs et comptes rattaches"], "CHIFFRE_AFFAIRES": ["chiffre d affaires"], "FONDS_PROPRES": ["total des capitaux propres"], "CHARGES_INTERETS": ["charges d interets"], "STOCKS": ["stocks"],
    "DETTES_FINANCIERES": ["dettes de financement", "total dettes de financement"], "DETTES_BANCAIRES_MLT": ["dettes de financement", "total dettes de financement"], "DETTES_BANCAIRES_CT": ["credits de tresorerie", "concours bancaires courants"],
    "COMPTE_COURANT_ASSOCIES": ["comptes d associes", "compte courant"], "CAISSE": ["caisse", "regie d avances"], "CA_EXPORT": ["ventes a l export", "ca a l export", "chiffre d affaires export"], "AUTRES_CHARGES_EXTERNES": ["autres charges externes", "autres charges d exploitation"],
    "TRESORERIE_ACTIF": ["total iii tresorerie actif", "tresorerie actif"], "TRESORERIE_PASSIF": ["total iii tresorerie passif", "tresorerie passif"], "CHARGES_FINANCIERES": ["charges financieres", "total v", "total des charges financieres"],
    "ACHATS_REVENDUS": ["achats revendus", "achats revendus de marchandises"], "ACHATS_CONSOMMES": ["achats consommes", "achat consommes"],
}
CANONICAL_LABEL = {
    "TOTAL_ACTIF": "TOTAL GENERAL I+II+III", "TOTAL_PASSIF": "TOTAL I+II+III", "ACTIFS_IMMOBILISES": "TOTAL I", "ACTIF_CIRCULANT": "TOTAL II", "TRESORERIE_ACTIF": "TOTAL TRESORERIE-ACTIF", "TRESORERIE_PASSIF": "TOTAL III TRESORERIE-PASSIF", "FONDS_PROPRES": "TOTAL DES CAPITAUX PROPRES",
    "DETTES_FINANCIERES": "TOTAL DES DETTES DE FINANCEMENT", "PASSIF_CIRCULANT": "TOTAL DU PASSIF CIRCULANT", "STOCKS": "TOTAL STOCKS", "CLIENTS": "Clients et comptes rattachés", "FOURNISSEURS": "Fournisseurs et comptes rattachés", "CHIFFRE_AFFAIRES": "Chiffre d'affaires", "RESULTAT_NET": "Résultat net",
    "RESULTAT_EXPLOITATION": "Résultat d'exploitation", "CHARGES_FINANCIERES": "Charges financières", "RESULTAT_COURANT": "Résultat courant",
}
DEFAULT_ROLE = {"IDENTIFICATION": "EXERCICE_N", "BILAN_ACTIF": "NET_N", "BILAN_PASSIF": "EXERCICE_N", "CPC": "TOTAL_EXERCICE_N", "DETAIL_CPC": "EXERCICE_N", "RESULTAT_FISCAL": "EXERCICE_N", "ESG": "EXERCICE_N"}
KEPT_FROM_ESG = "CHIFFRE_AFFAIRES RESULTAT_EXPLOITATION RESULTAT_COURANT RESULTAT_NET RESULTAT_NET_XIII RESULTAT_NET_XVI ACHATS_CONSOMMES ACHATS_REVENDUS DOTATIONS_AMORTISSEMENTS CHARGES_FINANCIERES PRODUITS_EXPLOITATION CHARGES_EXPLOITATION CAF".split()
SECTION_TOTAL_CODES = "ACTIFS_IMMOBILISES ACTIF_CIRCULANT FONDS_PROPRES DETTES_FINANCIERES PASSIF_CIRCULANT TRESORERIE_ACTIF TRESORERIE_PASSIF".split()
CODE_ALIASES = {"TOTAL_GENERAL": "TOTAL_ACTIF", "CA": "CHIFFRE_AFFAIRES", "CHIFFRE_D_AFFAIRES": "CHIFFRE_AFFAIRES", "CHIFFRE_D'AFFAIRES": "CHIFFRE_AFFAIRES", "RN": "RESULTAT_NET", "RESULTAT_NET_DE_L_EXERCICE": "RESULTAT_NET", "CAPITAUX_PROPRES": "FONDS_PROPRES"}
PERIOD_ALIASES = {"N-1": "N_MINUS_1", "N1": "N_MINUS_1", "N_1": "N_MINUS_1", "EXERCICE_PRECEDENT": "N_MINUS_1", "PREV": "N_MINUS_1", "CURRENT": "N", "EXERCICE": "N", "N": "N", "N_MINUS_1": "N_MINUS_1"}
ROLE_ALIASES = {"NET": "NET_N", "NET_EXERCICE": "NET_N", "EXERCICE": "EXERCICE_N", "EXERCICE_PRECEDENT": "EXERCICE_N1", "N-1": "EXERCICE_N1", "TOTALS": "TOTAL_EXERCICE_N", "TOTAUX": "TOTAL_EXERCICE_N", "3": "TOTAL_EXERCICE_N", "4": "EXERCICE_N1"}
ROLES = "IDENTITY_VALUE BRUT AMORT_PROV NET_N EXERCICE_N TOTAL_EXERCICE_N EXERCICE_N1 MONTANT_N MONTANT_N1 UNKNOWN".split()
NATURES = "DETAIL SUBTOTAL SECTION_TOTAL GRAND_TOTAL".split()
#: Headings of the current year's totals in the income statement.
CURRENT_TOTAL_HEADINGS = ["3 1 2", "totaux de l exercice", "totaux de lexercice", "total de l exercice", "total de lexercice", "taux du exercice", "taux de l exercice", "taux de lexercice"]
#: Misreadings put right before accents go.
LABEL_FIXES = [(r"\bdettees\b", "dettes"), (r"\bimmobliisations\b", "immobilisations"), (r"\bsolid\s+es\s+crediteurs\b", "soldes crediteurs"), (r"\bsoldes\s+crediteurs\b", "soldes crediteurs")]
TOTAL_GENERAL = r"(?i)\btotal\s+(?:general\s+)?i\s*(?:\+|\s)\s*ii\s*(?:\+|\s)\s*iii\b"

#: Page types with their markers and the hits that settle a type, in the order in which ties fall.
MARKERS = [
    ("IDENTIFICATION", 2, ["identification du contribuable", "pieces annexes a la declaration", "raison sociale", "identifiant fiscal"]),
    ("BILAN_ACTIF", 2, ["bilan actif", "bilan - actif", "immobilisations incorporelles", "immobilisations corporelles", "creances de l actif circulant", "tresorerie actif", "total general i"]),
    ("BILAN_PASSIF", 2, ["bilan passif", "bilan - passif", "capitaux propres", "dettes de financement", "passif circulant", "tresorerie passif"]),
    ("DETAIL_CPC", 1, ["detail des postes du cpc", "detail des postes du c p c", "redevances de credit bail", "achats consommes de matieres"]),
    ("RESULTAT_FISCAL", 1, ["passage du resultat net comptable", "resultat net fiscal", "reintegrations fiscales", "deductions fiscales"]),
    ("ESG", 1, ["etat des soldes de gestion", "capacite d autofinancement", "tableau de formation des resultats", "valeur ajoutee"]),
    ("CPC", 2, ["compte de produits et charges", "produits d exploitation", "charges d exploitation", "resultat financier", "resultat courant", "chiffre d affaires"]),
]
CONTINUATION = {
    "BILAN_ACTIF": ["immobilisation", "actif circulant", "tresorerie actif", "creances", "stocks"],
    "BILAN_PASSIF": ["capitaux propres", "dettes de financement", "passif circulant", "tresorerie passif"],
    "CPC": ["produits d exploitation", "charges d exploitation", "produits financiers", "charges financieres", "resultat"],
}
FIRM_IDENTIFICATION = ["identification du contribuable", "pieces annexes a la declaration"]
NEXT_TYPES = {"IDENTIFICATION": ["BILAN_ACTIF", "BILAN_PASSIF", "CPC"], "BILAN_ACTIF": ["BILAN_PASSIF", "CPC", "BILAN_ACTIF"], "BILAN_PASSIF": ["CPC", "DETAIL_CPC", "BILAN_ACTIF"], "CPC": ["DETAIL_CPC", "RESULTAT_FISCAL", "CPC", "BILAN_PASSIF"], "DETAIL_CPC": ["RESULTAT_FISCAL", "ESG", "CPC"], "RESULTAT_FISCAL": ["ESG", "DETAIL_CPC", "CPC"], "ESG": ["DETAIL_CPC", "RESULTAT_FISCAL"]}
FALLBACK_TYPES = ["BILAN_ACTIF", "BILAN_PASSIF", "CPC", "DETAIL_CPC", "RESULTAT_FISCAL", "ESG"]

#: Output fields: number, code, label, statement, and the values it is taken from in order of preference.
OUTPUTS = [
    (1, "ACTIFS_IMMOBILISES", "Actifs immobilisés", "Bilan Actif", ["ACTIFS_IMMOBILISES"]), (2, "TOTAL_BILAN", "Total bilan", "Bilan Actif", ["TOTAL_BILAN", "TOTAL_ACTIF", "TOTAL_PASSIF"]), (3, "CHIFFRE_AFFAIRES", "Chiffre d'affaires", "CPC", ["CHIFFRE_AFFAIRES"]),
    (4, "CA_EXPORT", "Chiffre d'affaires à l'export", "CPC", ["CA_EXPORT"]), (5, "DETTES_BANCAIRES_MLT", "Dettes bancaires MLT", "Bilan Passif", ["DETTES_BANCAIRES_MLT", "DETTES_FINANCIERES"]), (6, "DETTES_BANCAIRES_CT", "Dettes bancaires CT", "Bilan Passif", ["DETTES_BANCAIRES_CT"]),
    (7, "PASSIF_CIRCULANT", "Passif circulant", "Bilan Passif", ["PASSIF_CIRCULANT"]), (8, "DETTES_FOURNISSEURS", "Dettes fournisseurs", "Bilan Passif", ["FOURNISSEURS"]), (9, "COMPTE_COURANT_ASSOCIES", "Compte courant d'associés", "Bilan", ["COMPTE_COURANT_ASSOCIES"]),
    (10, "TRESORERIE_PASSIF", "Trésorerie passif", "Bilan Passif", ["TRESORERIE_PASSIF"]), (11, "ACTIF_CIRCULANT", "Actif circulant", "Bilan Actif", ["ACTIF_CIRCULANT"]), (12, "CREANCES_CLIENTS", "Créances clients", "Bilan Actif", ["CLIENTS"]), (13, "TRESORERIE_ACTIF", "Trésorerie actif", "Bilan Actif", ["TRESORERIE_ACTIF"]),
    (14, "CAISSE", "Caisse actif", "Bilan Actif", ["CAISSE"]), (15, "ACHATS_REVENDUS", "Achats revendus", "CPC", ["ACHATS_REVENDUS", "ACHATS_TOTAL"]), (16, "ACHATS_CONSOMMES", "Achats consommés", "CPC", ["ACHATS_CONSOMMES"]), (17, "AUTRES_CHARGES_EXTERNES", "Autres charges externes", "CPC", ["AUTRES_CHARGES_EXTERNES"]),
    (18, "CHARGES_INTERETS", "Charges d'intérêts", "CPC", ["CHARGES_INTERETS", "CHARGES_FINANCIERES"]), (19, "RESULTAT_NET", "Résultat net", "CPC", ["RESULTAT_NET"]), (20, "TYPE_RESULTAT", "Type de résultat", "Dérivé", []),
]

#: Wordings of each field for fuzzy matching, in the order in which ties fall.
FIELD_WORDINGS = {
    "CHIFFRE_AFFAIRES": ["chiffre d affaires", "chiffres d affaires", "total chiffre d affaires", "ventes de biens et services produits"], "CHIFFRE_AFFAIRES_N1": ["chiffre d affaires n 1", "chiffre d affaires exercice precedent"], "RESULTAT_NET": ["resultat net", "resultat net de l exercice", "xiii resultat net", "xvi resultat net"],
    "RESULTAT_NET_N1": ["resultat net n 1", "resultat net exercice precedent"], "RESULTAT_EXPLOITATION": ["resultat d exploitation", "iii resultat d exploitation"], "TOTAL_BILAN": ["total general i ii iii", "total general", "total actif", "total passif", "total du bilan"], "FONDS_PROPRES": ["total des capitaux propres", "capitaux propres", "total i capitaux propres"],
    "DETTES_FINANCIERES": ["dettes de financement", "total dettes de financement", "dettes financieres"], "DETTES_BANCAIRES_CT": ["credits de tresorerie", "dettes bancaires ct", "banques soldes crediteurs"], "TRESORERIE_ACTIF": ["tresorerie actif", "total iii tresorerie actif", "banques caisses et credit d escompte"], "TRESORERIE_PASSIF": ["tresorerie passif", "total iii tresorerie passif", "credits de tresorerie"],
    "ACTIF_CIRCULANT": ["actif circulant", "total ii actif circulant"], "PASSIF_CIRCULANT": ["passif circulant", "total ii passif circulant", "dettes du passif circulant"], "STOCKS": ["stocks", "stocks et en cours"], "CLIENTS": ["clients et comptes rattaches", "clients"], "FOURNISSEURS": ["fournisseurs et comptes rattaches", "fournisseurs"],
    "ACHATS": ["achats revendus de marchandises", "achats consommes de matieres et fournitures", "achats"], "FRAIS_FINANCIERS": ["charges d interets", "frais financiers", "charges financieres"], "AMORTISSEMENTS": ["dotations d exploitation", "dotations aux amortissements", "dotations d exploitation amortissements et provisions"], "CAF": ["capacite d autofinancement", "caf", "autofinancement"],
    "FDR": ["fonds de roulement", "fdr"], "BFDR": ["besoin de financement de roulement", "bfr", "bfdr"], "TRESORERIE_NETTE": ["tresorerie nette"], "ENCOURS_LEASING": ["encours leasing", "credit bail", "encours credit bail"], "CMT": ["cmt", "credit moyen terme"], "NOUVEAU_FINANCEMENT": ["nouveau financement", "montant demande"], "ACTIFS_IMMOBILISES": ["actif immobilise", "total i actif immobilise", "actifs immobilises"],
    "RESULTAT_FISCAL": ["resultat fiscal", "benefice fiscal", "deficit fiscal"], "REINTEGRATIONS": ["reintegrations", "total des reintegrations"], "DEDUCTIONS": ["deductions", "total des deductions"], "IS_DU": ["impot sur les societes", "is du", "impot du"], "COTISATION_MINIMALE": ["cotisation minimale"], "REPORT_DEFICITAIRE": ["report deficitaire", "deficits anterieurs"],
}
PREFERRED_COLUMNS = ["net_n", "total_exercice", "exercice", "net", "value", "brut"]
COLUMN_NAMES = {"brut": "brut", "amortissements": "amortissements", "amortissements et provisions": "amortissements", "net": "net_n", "net exercice n": "net_n", "net n": "net_n", "exercice n": "net_n", "exercice precedent": "net_n_1", "total de l exercice": "total_exercice", "operations propres": "exercice", "exercices precedents": "exercices_precedents"}
SECTION_HEADINGS = [("BILAN_ACTIF", r"(?i)bilan\s*[-–]?\s*actif|actif\s+du\s+bilan"), ("BILAN_PASSIF", r"(?i)bilan\s*[-–]?\s*passif|passif\s+du\s+bilan"), ("CPC", r"(?i)compte\s+de\s+produits\s+et\s+charges|\bcpc\b"), ("DETAIL_POSTES", r"(?i)d[eé]tail\s+des\s+postes"), ("RESULTAT_FISCAL", r"(?i)passage\s+du\s+r[eé]sultat|resultat\s+fiscal"), ("ESG", r"(?i)etat\s+des\s+soldes|capacité\s+d.?autofinancement|\besg\b")]
#: Controls: code, the expected term or terms, what is observed. All of a failed control's fields fall with it, and for the balance its total too.
CONTROLS = [
    ("bilan_equilibre", ("TOTAL_ACTIF",), "TOTAL_PASSIF"), ("tresorerie_nette", ("TRESORERIE_ACTIF", "-", "TRESORERIE_PASSIF"), "TRESORERIE_NETTE"), ("resultat_exploitation", ("PRODUITS_EXPLOITATION", "-", "CHARGES_EXPLOITATION"), "RESULTAT_EXPLOITATION"), ("resultat_financier", ("PRODUITS_FINANCIERS", "-", "CHARGES_FINANCIERES"), "RESULTAT_FINANCIER"),
    ("resultat_courant", ("RESULTAT_EXPLOITATION", "+", "RESULTAT_FINANCIER"), "RESULTAT_COURANT"), ("resultat_non_courant", ("PRODUITS_NON_COURANTS", "-", "CHARGES_NON_COURANTES"), "RESULTAT_NON_COURANT"), ("resultat_avant_impot", ("RESULTAT_COURANT", "+", "RESULTAT_NON_COURANT"), "RESULTAT_AVANT_IMPOT"), ("resultat_net", ("RESULTAT_AVANT_IMPOT", "-", "IMPOT_SUR_RESULTATS"), "RESULTAT_NET"),
]

# --- What an attempt must show, and how many rows an answer may hold. Fixed values. ---

MEANINGFUL_CODES = {
    "IDENTIFICATION": ["RAISON_SOCIALE", "IDENTIFIANT_FISCAL", "ICE", "ADRESSE", "DATE_DEBUT_EXERCICE", "DATE_FIN_EXERCICE", "EXERCICE"],
    "BILAN_ACTIF": ["TOTAL_ACTIF", "STOCKS", "CLIENTS", "TRESORERIE_ACTIF", "ACTIF_CIRCULANT", "ACTIFS_IMMOBILISES"],
    "BILAN_PASSIF": ["FONDS_PROPRES", "DETTES_FINANCIERES", "TOTAL_PASSIF", "FOURNISSEURS", "PASSIF_CIRCULANT", "TRESORERIE_PASSIF", "DETTES_BANCAIRES_CT"],
    "CPC": ["CHIFFRE_AFFAIRES", "RESULTAT_NET", "RESULTAT_NET_XIII", "RESULTAT_NET_XVI", "RESULTAT_EXPLOITATION", "RESULTAT_COURANT", "RESULTAT_FINANCIER", "CHARGES_FINANCIERES", "ACHATS", "ACHATS_REVENDUS", "ACHATS_CONSOMMES", "FRAIS_FINANCIERS", "AMORTISSEMENTS", "DOTATIONS_AMORTISSEMENTS"],
    "DETAIL_CPC": ["REDEVANCES_CREDIT_BAIL", "ACHATS"],
    "RESULTAT_FISCAL": ["RESULTAT_FISCAL", "REINTEGRATIONS", "DEDUCTIONS", "IS_DU", "COTISATION_MINIMALE", "REPORT_DEFICITAIRE"],
    "ESG": ["CAF", "FDR", "BFDR", "TRESORERIE_NETTE"],
}
MOST_ROWS = {"IDENTIFICATION": 20, "BILAN_ACTIF": 30, "BILAN_PASSIF": 30, "CPC": 40, "DETAIL_CPC": 15, "RESULTAT_FISCAL": 20, "ESG": 15}

#: Of each event of a job: its step, its percentage where that is fixed, the status it brings.
JOB_STEPS = {
    "job_started": ("validating", 2, "processing"),
    "pdf_validated": ("validating", 5, None),
    "pages_rendered": ("rendering", 15, None),
    "page_classified": ("classifying", None, None),
    "page_extracted": ("extracting_page", None, None),
    "page_skipped": ("extracting_page", None, None),
    "page_failed": ("extracting_page", None, None),
    "resolving_fields": ("resolving", 85, None),
    "running_controls": ("controls", 92, None),
    "result_ready": ("completed", 100, "completed"),
    "job_failed": ("failed", None, "failed"),
}
#: Events that end a job's stream of events.
LAST_EVENTS = ["result_ready", "job_failed"]

#: Types that the next page goes by, and what a page is taken for after one of them where the connector says identification once more.
PAGE_TYPES = ["IDENTIFICATION", "BILAN_ACTIF", "BILAN_PASSIF", "CPC", "DETAIL_CPC", "RESULTAT_FISCAL", "ESG"]
GUESSED_NEXT = {"BILAN_ACTIF": "BILAN_PASSIF", "BILAN_PASSIF": "CPC", "CPC": "DETAIL_CPC"}

#: Attributes of a document's dataset that always stand, and those that stand where a code writes them.
DATASET_ATTRIBUTES = [
    "chiffre_affaires", "chiffre_affaires_n1", "resultat_net", "resultat_net_n1", "resultat_exploitation", "total_bilan", "total_bilan_n1", "fonds_propres", "fonds_propres_n1", "dettes_financieres", "dettes_financieres_n1", "dettes_bancaires_ct",
    "tresorerie_actif", "tresorerie_passif", "actif_circulant", "passif_circulant", "stocks", "clients", "fournisseurs", "achats", "frais_financiers", "amortissements", "caf", "fdr", "bfdr", "tresorerie_nette", "encours_leasing", "cmt",
    "nouveau_financement", "resultat_fiscal", "reintegrations", "deductions", "is_du", "cotisation_minimale", "report_deficitaire",
]
OPTIONAL_ATTRIBUTES = [
    "actifs_immobilises", "produits_exploitation", "charges_exploitation", "produits_financiers", "charges_financieres", "resultat_financier", "resultat_courant", "produits_non_courants", "charges_non_courantes", "resultat_non_courant",
    "resultat_avant_impot", "impot_sur_resultats", "total_actif", "total_passif", "achats_revendus", "achats_consommes", "redevances_credit_bail", "ca_export", "dettes_bancaires_mlt", "compte_courant_associes", "caisse", "autres_charges_externes",
]
#: Codes whose attribute is not their own name in lower case.
ATTRIBUTE_OF = {"AUTRES_CHARGES_EXTERNES_DETAIL": "autres_charges_externes", "ACHATS_TOTAL": "achats", "CHARGES_INTERETS": "frais_financiers", "DOTATIONS_AMORTISSEMENTS": "amortissements"}
#: Codes that are resolved first, in order; all others follow as their first candidates stand.
RESOLVED_FIRST = [
    "ACTIFS_IMMOBILISES", "ACTIF_CIRCULANT", "TRESORERIE_ACTIF", "TRESORERIE_PASSIF", "FONDS_PROPRES", "PASSIF_CIRCULANT", "TOTAL_ACTIF", "TOTAL_PASSIF", "RESULTAT_NET", "CLIENTS", "FOURNISSEURS", "STOCKS", "DETTES_FINANCIERES",
    "CHIFFRE_AFFAIRES", "RESULTAT_EXPLOITATION", "ACHATS_REVENDUS", "CHARGES_INTERETS", "CHARGES_FINANCIERES", "ENCOURS_LEASING", "REDEVANCES_CREDIT_BAIL", "TOTAL_BILAN",
]
