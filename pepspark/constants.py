"""Fixed values of peptide chemistry: element and residue masses, ion types, pK sets, hydropathicity, cleavage rules.

All tables are plain dicts; functions take any of them as a parameter.
"""

from __future__ import annotations

# NIST masses of the common elements: {isotope: (mass, abundance)}; 0 is the most abundant one.
NIST_MASS: dict[str, dict[int, tuple[float, float]]] = {
    "H": {0: (1.00782503207, 1.0), 1: (1.00782503207, 0.999885), 2: (2.0141017778, 0.000115)},
    "C": {0: (12.0, 1.0), 12: (12.0, 0.9893), 13: (13.0033548378, 0.0107)},
    "N": {0: (14.0030740048, 1.0), 14: (14.0030740048, 0.99636), 15: (15.0001088982, 0.00364)},
    "O": {0: (15.99491461956, 1.0), 16: (15.99491461956, 0.99757), 17: (16.9991317, 0.00038), 18: (17.999161, 0.00205)},
    "P": {0: (30.97376163, 1.0), 31: (30.97376163, 1.0)},
    "S": {0: (31.972071, 1.0), 32: (31.972071, 0.9499), 33: (32.97145876, 0.0075), 34: (33.9678669, 0.0425), 36: (35.96708076, 0.0001)},
    "Se": {0: (79.9165213, 1.0), 74: (73.9224764, 0.0089), 76: (75.9192136, 0.0937), 77: (76.919914, 0.0763), 78: (77.9173091, 0.2377), 80: (79.9165213, 0.4961), 82: (81.9166994, 0.0873)},
    "F": {0: (18.99840322, 1.0), 19: (18.99840322, 1.0)},
    "Cl": {0: (34.96885268, 1.0), 35: (34.96885268, 0.7576), 37: (36.96590259, 0.2424)},
    "Br": {0: (78.9183371, 1.0), 79: (78.9183371, 0.5069), 81: (80.9162906, 0.4931)},
    "I": {0: (126.904473, 1.0), 127: (126.904473, 1.0)},
    "Na": {0: (22.9897692809, 1.0), 23: (22.9897692809, 1.0)},
    "K": {0: (38.96370668, 1.0), 39: (38.96370668, 0.932581), 40: (39.96399848, 0.000117), 41: (40.96182576, 0.067302)},
    "Li": {0: (7.01600455, 1.0), 6: (6.015122795, 0.0759), 7: (7.01600455, 0.9241)},
    "Ca": {0: (39.96259098, 1.0), 40: (39.96259098, 0.96941), 42: (41.95861801, 0.00647), 43: (42.9587666, 0.00135), 44: (43.9554818, 0.02086), 46: (45.9536926, 4e-05), 48: (47.952534, 0.00187)},
    "Fe": {0: (55.9349375, 1.0), 54: (53.9396105, 0.05845), 56: (55.9349375, 0.91754), 57: (56.935394, 0.02119), 58: (57.9332756, 0.00282)},
    "Mg": {0: (23.9850417, 1.0), 24: (23.9850417, 0.7899), 25: (24.98583692, 0.1), 26: (25.982592929, 0.1101)},
    "Cu": {0: (62.9295975, 1.0), 63: (62.9295975, 0.6915), 65: (64.9277895, 0.3085)},
    "Zn": {0: (63.9291422, 1.0), 64: (63.9291422, 0.48268), 66: (65.9260334, 0.27975), 67: (66.9271273, 0.04102), 68: (67.9248442, 0.19024), 70: (69.9253193, 0.00631)},
    "Si": {0: (27.9769265325, 1.0), 28: (27.9769265325, 0.92223), 29: (28.9764947, 0.04685), 30: (29.97377017, 0.03092)},
    "B": {0: (11.0093054, 1.0), 10: (10.012937, 0.199), 11: (11.0093054, 0.801)},
    "Ag": {0: (106.905097, 1.0), 107: (106.905097, 0.51839), 109: (108.904752, 0.48161)},
    "Al": {0: (26.98153863, 1.0), 27: (26.98153863, 1.0)},
    "As": {0: (74.9215965, 1.0), 75: (74.9215965, 1.0)},
    "Au": {0: (196.9665687, 1.0), 197: (196.9665687, 1.0)},
    "Co": {0: (58.933195, 1.0), 59: (58.933195, 1.0)},
    "Cr": {0: (51.9405075, 1.0), 50: (49.9460442, 0.04345), 52: (51.9405075, 0.83789), 53: (52.9406494, 0.09501), 54: (53.9388804, 0.02365)},
    "Cs": {0: (132.905451933, 1.0), 133: (132.905451933, 1.0)},
    "Hg": {0: (201.970643, 1.0), 196: (195.965833, 0.0015), 198: (197.966769, 0.0997), 199: (198.9682799, 0.1687), 200: (199.968326, 0.231), 201: (200.9703023, 0.1318), 202: (201.970643, 0.2986), 204: (203.9734939, 0.0687)},
    "Mn": {0: (54.9380451, 1.0), 55: (54.9380451, 1.0)},
    "Mo": {0: (97.9054082, 1.0), 92: (91.906811, 0.1477), 94: (93.9050883, 0.0923), 95: (94.9058421, 0.159), 96: (95.9046795, 0.1668), 97: (96.9060215, 0.0956), 98: (97.9054082, 0.2419), 100: (99.907477, 0.0967)},
    "Ni": {0: (57.9353429, 1.0), 58: (57.9353429, 0.680769), 60: (59.9307864, 0.262231), 61: (60.931056, 0.011399), 62: (61.9283451, 0.036345), 64: (63.927966, 0.009256)},
    "Pt": {0: (194.9647911, 1.0), 190: (189.959932, 0.00014), 192: (191.961038, 0.00782), 194: (193.9626803, 0.32967), 195: (194.9647911, 0.33832), 196: (195.9649515, 0.25242), 198: (197.967893, 0.07163)},
    "Rb": {0: (84.911789738, 1.0), 85: (84.911789738, 0.7217), 87: (86.909180527, 0.2783)},
    "Ti": {0: (47.9479463, 1.0), 46: (45.9526316, 0.0825), 47: (46.9517631, 0.0744), 48: (47.9479463, 0.7372), 49: (48.94787, 0.0541), 50: (49.9447912, 0.0518)},
    "V": {0: (50.9439595, 1.0), 50: (49.9471585, 0.0025), 51: (50.9439595, 0.9975)},
    "H+": {0: (1.00727646677, 1.0), 1: (1.00727646677, 1.0)},
    "e*": {0: (0.00054857990943, 1.0)},
}
PROTON = 1.00727646677

#: Elemental composition of residues and of the standard termini.
AA_COMPOSITION: dict[str, dict[str, int]] = {
    "A": {"H": 5, "C": 3, "O": 1, "N": 1},
    "C": {"H": 5, "C": 3, "S": 1, "O": 1, "N": 1},
    "D": {"H": 5, "C": 4, "O": 3, "N": 1},
    "E": {"H": 7, "C": 5, "O": 3, "N": 1},
    "F": {"H": 9, "C": 9, "O": 1, "N": 1},
    "G": {"H": 3, "C": 2, "O": 1, "N": 1},
    "H": {"H": 7, "C": 6, "N": 3, "O": 1},
    "I": {"H": 11, "C": 6, "O": 1, "N": 1},
    "J": {"H": 11, "C": 6, "O": 1, "N": 1},
    "K": {"H": 12, "C": 6, "N": 2, "O": 1},
    "L": {"H": 11, "C": 6, "O": 1, "N": 1},
    "M": {"H": 9, "C": 5, "S": 1, "O": 1, "N": 1},
    "N": {"H": 6, "C": 4, "O": 2, "N": 2},
    "O": {"H": 19, "C": 12, "O": 2, "N": 3},
    "P": {"H": 7, "C": 5, "O": 1, "N": 1},
    "Q": {"H": 8, "C": 5, "O": 2, "N": 2},
    "R": {"H": 12, "C": 6, "N": 4, "O": 1},
    "S": {"H": 5, "C": 3, "O": 2, "N": 1},
    "T": {"H": 7, "C": 4, "O": 2, "N": 1},
    "U": {"H": 5, "C": 3, "O": 1, "N": 1, "Se": 1},
    "V": {"H": 9, "C": 5, "O": 1, "N": 1},
    "W": {"C": 11, "H": 10, "N": 2, "O": 1},
    "Y": {"H": 9, "C": 9, "O": 2, "N": 1},
}
TERMINI: dict[str, dict[str, int]] = {"H-": {"H": 1}, "-OH": {"O": 1, "H": 1}}

#: Monoisotopic residue masses.
AA_MASS: dict[str, float] = {
    "G": 57.02146372057, "A": 71.03711378471, "S": 87.03202840427001, "P": 97.05276384885, "V": 99.06841391299, "T": 101.04767846841, "C": 103.00918478471, "L": 113.08406397713001, "I": 113.08406397713001, "J": 113.08406397713001, "N": 114.04292744114001, "D": 115.02694302383001,
    "Q": 128.05857750527997, "K": 128.09496301399997, "E": 129.04259308796998, "M": 131.04048491299, "H": 137.05891185845002, "F": 147.06841391298997, "U": 150.95363508471, "R": 156.10111102359997, "Y": 163.06332853254997, "W": 186.07931294985997, "O": 237.14772686284996,
}

#: Composition of each fragment ion type relative to residues + H2O, as a formula.
ION_FORMULA: dict[str, str] = {
    "M": "", "M-H2O": "H-2O-1", "M-NH3": "N-1H-3",
    "a": "H-2O-2C-1", "a+1": "H-1O-2C-1", "a-H2O": "H-4O-3C-1", "a-NH3": "H-5O-2C-1N-1",
    "b": "H-2O-1", "b-H2O": "H-4O-2", "b-NH3": "H-5O-1N-1",
    "c": "H1O-1N1", "c-1": "O-1N1", "c-dot": "H2O-1N1", "c+1": "H2O-1N1", "c+2": "H3O-1N1", "c-H2O": "H-1O-2N1", "c-NH3": "H-2O-1",
    "x": "H-2O1C1", "x+1": "H-1O1C1", "x-H2O": "H-4C1", "x-NH3": "H-5O1C1N-1",
    "y": "", "y-H2O": "H-2O-1", "y-NH3": "N-1H-3",
    "z-1": "H-4N-1", "z": "H-3N-1", "z-dot": "H-2N-1", "z+1": "H-2N-1", "z+2": "H-1N-1", "z+3": "N-1", "z-H2O": "H-5O-1N-1", "z-NH3": "H-6N-2",
}

# Published pK sets {group: (pK, charge)}.
PK_LEHNINGER = {"E": (4.25, -1), "R": (12.48, 1), "Y": (10.07, -1), "D": (3.65, -1), "H": (6.0, 1), "K": (10.53, 1), "C": (8.18, -1), "H-": (9.69, 1), "-OH": (2.34, -1)}
PK_SILLERO = {"E": (4.5, -1), "R": (12.0, 1), "Y": (10.0, -1), "D": (4.0, -1), "H": (6.4, 1), "K": (10.4, 1), "C": (9.0, -1), "H-": (8.2, 1), "-OH": (3.2, -1)}
PK_DAWSON = {"E": (4.3, -1), "R": (12.0, 1), "Y": (10.1, -1), "D": (3.9, -1), "H": (6.0, 1), "K": (10.5, 1), "C": (8.3, -1), "H-": (8.2, 1), "-OH": (3.2, -1)}
PK_RODWELL = {"E": (4.25, -1), "R": (11.5, 1), "Y": (10.7, -1), "D": (3.86, -1), "H": (6.0, 1), "K": (11.5, 1), "C": (8.33, -1), "H-": (8.0, 1), "-OH": (3.1, -1)}
PK_BJELLQVIST = {"E": (4.45, -1), "R": (12.0, 1), "Y": (10.0, -1), "D": (4.05, -1), "H": (5.98, 1), "K": (10.0, 1), "C": (9.0, -1), "H-": (7.5, 1), "-OH": (3.55, -1)}
PK_NTERM_BJELLQVIST = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_CTERM_BJELLQVIST = {"D": 4.55, "E": 4.75}

#: Hydropathicity of Kyte and Doolittle.
HYDROPATHICITY_KD = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}

# Cleavage rules; the bond after the matched residue is cut.
EXPASY_RULES: dict[str, str] = {
    "arg-c": r"R",
    "asp-n": r"\w(?=D)",
    "bnps-skatole": r"W",
    "caspase 1": r"(?<=[FWYL]\w[HAT])D(?=[^PEDQKR])",
    "caspase 2": r"(?<=DVA)D(?=[^PEDQKR])",
    "caspase 3": r"(?<=DMQ)D(?=[^PEDQKR])",
    "caspase 4": r"(?<=LEV)D(?=[^PEDQKR])",
    "caspase 5": r"(?<=[LW]EH)D",
    "caspase 6": r"(?<=VE[HI])D(?=[^PEDQKR])",
    "caspase 7": r"(?<=DEV)D(?=[^PEDQKR])",
    "caspase 8": r"(?<=[IL]ET)D(?=[^PEDQKR])",
    "caspase 9": r"(?<=LEH)D",
    "caspase 10": r"(?<=IEA)D",
    "chymotrypsin high specificity": r"([FY](?=[^P]))|(W(?=[^MP]))",
    "chymotrypsin low specificity": r"([FLY](?=[^P]))|(W(?=[^MP]))|(M(?=[^PY]))|(H(?=[^DMPW]))",
    "clostripain": r"R",
    "cnbr": r"M",
    "enterokinase": r"(?<=[DE]{3})K",
    "factor xa": r"(?<=[AFGILTVM][DE]G)R",
    "formic acid": r"D",
    "glutamyl endopeptidase": r"E",
    "granzyme b": r"(?<=IEP)D",
    "hydroxylamine": r"N(?=G)",
    "iodosobenzoic acid": r"W",
    "lysc": r"K",
    "ntcb": r"\w(?=C)",
    "pepsin ph1.3": r"((?<=[^HKR][^P])[^R](?=[FL][^P]))|((?<=[^HKR][^P])[FL](?=\w[^P]))",
    "pepsin ph2.0": r"((?<=[^HKR][^P])[^R](?=[FLWY][^P]))|((?<=[^HKR][^P])[FLWY](?=\w[^P]))",
    "proline endopeptidase": r"(?<=[HKR])P(?=[^P])",
    "proteinase k": r"[AEFILTVWY]",
    "staphylococcal peptidase i": r"(?<=[^E])E",
    "thermolysin": r"[^DE](?=[AFILMV][^P])",
    "thrombin": r"((?<=G)R(?=G))|((?<=[AFGILTVM][AFGILTVWA]P)R(?=[^DE][^DE]))",
    "trypsin": r"([KR](?=[^P]))|((?<=W)K(?=P))|((?<=M)R(?=P))",
    "trypsin_exception": r"((?<=[CD])K(?=D))|((?<=C)K(?=[HY]))|((?<=C)R(?=K))|((?<=R)R(?=[HR]))",
}
# PSI-MS cleavage rules: name -> (accession, pattern of the cut position).
PSIMS_RULES: dict[str, tuple[str, str]] = {
    "2-iodobenzoate": ("MS:1001918", r"(?<=W)"),
    "Arg-C": ("MS:1001303", r"(?<=R)(?!P)"),
    "Asp-N": ("MS:1001304", r"(?=[BD])"),
    "Asp-N ambic": ("MS:1001305", r"(?=[DE])"),
    "CNBr": ("MS:1001307", r"(?<=M)"),
    "Chymotrypsin": ("MS:1001306", r"(?<=[FYWL])(?!P)"),
    "Formic acid": ("MS:1001308", r"((?<=D))|((?=D))"),
    "Lys-C": ("MS:1001309", r"(?<=K)(?!P)"),
    "Lys-C/P": ("MS:1001310", r"(?<=K)"),
    "PepsinA": ("MS:1001311", r"(?<=[FL])"),
    "TrypChymo": ("MS:1001312", r"(?<=[FYWLKR])(?!P)"),
    "Trypsin": ("MS:1001251", r"(?<=[KR])(?!P)"),
    "Trypsin/P": ("MS:1001313", r"(?<=[KR])"),
    "V8-DE": ("MS:1001314", r"(?<=[BDEZ])(?!P)"),
    "V8-E": ("MS:1001315", r"(?<=[EZ])(?!P)"),
    "glutamyl endopeptidase": ("MS:1001917", r"(?<=[^E]E)"),
    "leukocyte elastase": ("MS:1001915", r"(?<=[ALIV])(?!P)"),
    "proline endopeptidase": ("MS:1001916", r"(?<=[HKR]P)(?!P)"),
}

# Published retention coefficients; further sets go in as a parameter of the same form.
RC_GUO_PH2_0 = {"aa": {"K": -2.1, "G": -0.2, "L": 8.1, "A": 2.0, "C": 2.6, "E": 1.1, "D": 0.2, "F": 8.1, "I": 7.4, "H": -2.1, "M": 5.5, "N": -0.6, "Q": 0.0, "P": 2.0, "S": -0.2, "R": -0.6, "T": 0.6, "W": 8.8, "V": 5.0, "Y": 4.5, "H-": 0.0, "-OH": 0.0}, "lcp": 0.0, "const": 0.0}
RC_GUO_PH7_0 = {"aa": {"K": -0.2, "G": -0.2, "L": 9.0, "A": 2.2, "C": 2.6, "E": -1.3, "D": -2.6, "F": 9.0, "I": 8.3, "H": 2.2, "M": 6.0, "N": -0.8, "Q": 0.0, "P": 2.2, "S": -0.5, "R": 0.9, "T": 0.3, "W": 9.5, "V": 5.7, "Y": 4.6, "H-": 0.0, "-OH": 0.0}, "lcp": 0.0, "const": 0.0}
RC_MEEK_PH2_1 = {"aa": {"K": -3.2, "G": -0.5, "L": 10.0, "A": -0.1, "C": -2.2, "E": -7.5, "D": -2.8, "F": 13.9, "I": 11.8, "H": 0.8, "M": 7.1, "N": -1.6, "Q": -2.5, "P": 8.0, "S": -3.7, "R": -4.5, "T": 1.5, "W": 18.1, "V": 3.3, "Y": 8.2, "H-": 0.0, "-OH": 0.0}, "lcp": 0.0, "const": 0.0}
RC_MEEK_PH7_4 = {"aa": {"K": 0.1, "G": 0.0, "L": 8.8, "A": 0.5, "C": -6.8, "E": -16.9, "D": -8.2, "F": 13.2, "I": 13.9, "H": -3.5, "M": 4.8, "N": 0.8, "Q": -4.8, "P": 6.1, "S": 1.2, "R": 0.8, "T": 2.7, "W": 14.9, "V": 2.7, "Y": 6.1, "H-": 0.0, "-OH": 0.0}, "lcp": 0.0, "const": 0.0}
RC_BROWNE_TFA = {"aa": {"K": -3.7, "G": -1.2, "L": 20.0, "A": 7.3, "C": -9.2, "E": -7.1, "D": -2.9, "F": 19.2, "I": 6.6, "H": -2.1, "M": 5.6, "N": -5.7, "Q": -0.3, "P": 5.1, "S": -4.1, "pS": -6.5, "R": -3.6, "T": 0.8, "pT": -1.6, "W": 16.3, "V": 3.5, "Y": 5.9, "pY": 3.5, "H-": 0.0, "-OH": 0.0}, "lcp": 0.0, "const": 0.0}
RC_PALMBLAD = {"aa": {"K": -0.66, "G": -0.29, "L": 2.28, "A": 0.41, "C": -1.32, "E": -0.26, "D": 0.04, "F": 2.68, "I": 2.70, "H": 0.57, "M": 0.98, "N": -0.54, "Q": 1.02, "P": 0.97, "S": -0.71, "R": -0.76, "T": 0.37, "W": 4.68, "V": 2.44, "Y": 2.78, "H-": 0.0, "-OH": 0.0}, "lcp": 0.0, "const": 0.0}
RC_YOSHIDA = {"aa": {"K": 2.77, "G": -0.16, "L": -2.31, "A": 0.28, "C": 0.80, "camC": 0.80, "E": 1.58, "D": 2.45, "F": -2.94, "I": -1.34, "H": 3.44, "M": -0.14, "N": 3.25, "Q": 2.35, "P": 0.77, "S": 2.53, "R": 3.90, "T": 1.73, "W": -1.80, "V": -2.19, "Y": -0.11, "H-": 0.0, "-OH": 0.0}, "lcp": 0.0, "const": 0.0}
RC_ZUBAREV = {"aa": {"A": 6.73, "E": 5.66, "C": 3.25, "D": 5.64, "G": 2.35, "F": 27.43, "I": 20.50, "H": -0.66, "K": -4.47, "M": 17.39, "L": 23.38, "N": 2.57, "Q": 2.93, "P": 5.66, "S": 3.58, "R": -2.55, "T": 4.88, "Y": 13.22, "W": 31.27, "V": 13.05, "camC": 3.25, "oxM": -7.61, "-OH": 0.0, "H-": 0.0}, "lcp": -0.21, "const": 0.53}
RC_BROWNE_HFBA = {"aa": {"K": -2.5, "G": -2.3, "L": 15.0, "A": 3.9, "C": -14.3, "E": -7.5, "D": -2.8, "F": 14.7, "I": 11.0, "H": 2.0, "M": 4.1, "N": -2.8, "Q": 1.8, "P": 5.6, "S": -3.5, "pS": -7.6, "R": 3.2, "T": 1.1, "pT": -3.0, "W": 17.8, "V": 2.1, "Y": 3.8, "pY": -0.3, "H-": 0.0, "-OH": 0.0}, "lcp": 0.0, "const": 0.0}
RC_YOSHIDA_LC = {"aa": {"A": 1.29, "C": 0.94, "camC": 0.94, "D": 3.89, "E": 4.40, "F": -4.18, "G": 1.29, "H": 7.57, "I": -2.65, "K": 7.33, "L": -3.93, "M": -1.48, "N": 6.65, "P": 1.03, "Q": 6.68, "R": 7.08, "S": 5.09, "T": 3.46, "V": -2.52, "W": -1.87, "Y": -0.46, "H-": 0.0, "-OH": 0.0}, "lcp": -0.2, "const": 0.0}
RC_GILAR_ATLANTIS_PH3_0 = {"aa": {"K": 15.90, "R": 13.64, "H": 12.94, "E": 2.97, "P": 4.77, "Q": 5.43, "D": 3.20, "C*": 4.87, "C": 4.87, "N": 3.91, "A": 3.34, "G": 3.33, "S": 3.04, "T": 2.71, "V": 1.75, "I": 0.65, "M": 1.13, "L": 0.13, "F": -1.17, "Y": -0.22, "W": -2.47}, "lcp": 0.0, "const": 21.33}
RC_GILAR_ATLANTIS_PH4_5 = {"aa": {"K": 15.49, "R": 13.33, "H": 12.19, "E": 6.93, "P": 5.89, "Q": 5.68, "D": 5.31, "C*": 5.23, "C": 5.23, "N": 4.07, "A": 3.6, "G": 3.46, "S": 2.62, "T": 2.33, "V": 1.42, "I": 0.84, "M": 0.34, "L": 0.29, "F": -1.21, "Y": -1.62, "W": -2.08}, "lcp": 0.0, "const": 23.95}
RC_GILAR_ATLANTIS_PH10_0 = {"aa": {"K": 25.23, "R": 23.38, "H": 5.94, "E": 0.59, "P": 4.00, "Q": 3.53, "D": -0.84, "C*": 3.52, "C": 3.52, "N": 3.26, "A": 3.64, "G": 3.02, "S": 2.28, "T": 1.74, "V": 1.05, "I": 1.51, "M": -0.61, "L": 0.25, "F": -0.17, "Y": -0.79, "W": 0.23}, "lcp": 0.0, "const": 13.78}
RC_GILAR_BEH = {"aa": {"K": 9.49, "R": 8.56, "H": 8.40, "E": 5.95, "P": 4.73, "Q": 4.65, "D": 4.97, "C": 3.47, "C*": 3.47, "N": 3.50, "A": 2.90, "G": 2.63, "S": 2.14, "T": 2.19, "V": 1.71, "I": 1.30, "M": 1.40, "L": 0.73, "F": -0.09, "Y": -0.40, "W": 0.11}, "lcp": 0.0, "const": 18.41}
RC_GILAR_BEH_AMIDE = {"aa": {"K": 7.19, "R": 6.68, "H": 6.16, "E": 6.11, "P": 3.18, "Q": 5.19, "D": 6.02, "C*": 3.71, "C": 3.71, "N": 4.16, "A": 2.64, "G": 3.12, "S": 3.17, "T": 3.41, "V": 0.83, "I": -0.69, "M": -0.12, "L": -1.24, "F": -1.93, "Y": 0.46, "W": -2.11}, "lcp": 0.0, "const": 24.26}
RC_GILAR_RP = {"aa": {"K": -1.015, "R": -0.681, "H": -1.937, "E": 1.475, "P": 3.496, "Q": 1.228, "D": 1.326, "C": 1.832, "C*": 1.832, "N": 0.299, "A": 2.322, "G": 1.172, "S": 1.165, "T": 1.894, "V": 5.695, "I": 8.343, "M": 5.128, "L": 9.069, "F": 10.877, "Y": 5.603, "W": 12.183}, "lcp": 0.0, "const": -3.696}
RC_KROKHIN_100A_FA = {"aa": {"K": -5.08, "G": -0.07, "L": 9.89, "A": 1.63, "C": 0.7, "camC": 0.7, "E": 1.75, "D": 0.95, "F": 11.92, "I": 9.06, "H": -5.05, "M": 6.96, "N": -0.59, "Q": 0.2, "P": 1.98, "S": 0.27, "R": -3.55, "T": 1.37, "W": 13.67, "V": 5.72, "Y": 5.97}, "lcp": 0.0, "const": 0.0}
RC_KROKHIN_100A_TFA = {"aa": {"K": -3.53, "G": -0.35, "L": 9.44, "A": 1.11, "C": 0.04, "camC": 0.04, "E": 1.08, "D": -0.22, "F": 11.34, "I": 7.86, "H": -3.04, "M": 6.57, "N": -1.44, "Q": -0.53, "P": 1.62, "S": -0.33, "R": -2.58, "T": 0.48, "W": 13.12, "V": 4.86, "Y": 5.4}, "lcp": 0.0, "const": 0.0}

#: Monosaccharide compositions used in glycan tags.
MONOSACCHARIDES: dict[str, str] = {"Hex": "C6H10O5", "HexNAc": "C8H13N1O5", "HexN": "C6H11N1O4", "HexS": "C6H10O8S1", "HexP": "C6H11O8P1", "HexA": "C6H8O6", "dHex": "C6H10O4", "Fuc": "C6H10O4", "Pen": "C5H8O4", "Hep": "C7H12O6", "NeuAc": "C11H17N1O8", "NeuGc": "C11H17N1O9", "Neu": "C9H15N1O7", "Sulf": "O3S1", "Phos": "H1O3P1"}

#: Some modifications by name (and Unimod id), as formulas; more go in as a table.
MODIFICATIONS: dict[str, tuple[int, str]] = {
    "Acetyl": (1, "H2C2O1"),
    "Amidated": (2, "H1N1O-1"),
    "Carbamidomethyl": (4, "H3C2N1O1"),
    "Carbamyl": (5, "H1C1N1O1"),
    "Deamidated": (7, "H-1N-1O1"),
    "Phospho": (21, "H1O3P1"),
    "Dehydrated": (23, "H-2O-1"),
    "Methyl": (34, "H2C1"),
    "Oxidation": (35, "O1"),
    "Dimethyl": (36, "H4C2"),
    "Trimethyl": (37, "H6C3"),
    "Sulfo": (40, "O3S1"),
    "HexNAc": (43, "H13C8N1O5"),
    "GlyGly": (121, "H6C4N2O2"),
    "GG": (121, "H6C4N2O2"),
    "Formyl": (122, "C1O1"),
    "Nitro": (354, "H-1N1O2"),
    "Dioxidation": (425, "O2"),
    "Malonyl": (747, "H2C3O3"),
    "Crotonyl": (1363, "H4C4O1"),
    "Succinyl": (64, "H4C4O3"),
    "Biotin": (3, "H14C10N2O2S1"),
}


def formula_composition(formula: str) -> dict[str, int]:
    """``H2[13]C`` style formulas: element, isotope in brackets after it, signed count (1 if missing)."""
    import re

    out: dict[str, int] = {}
    for el, iso, n in re.findall(r"([A-Z][a-z+]*)(?:\[(\d+)\])?([+-]?\d+)?", formula):
        key = f"{el}[{iso}]" if iso else el
        out[key] = out.get(key, 0) + int(n or 1)
    return {k: v for k, v in out.items() if v}


def element_mass(symbol: str, average: bool = False, table: dict | None = None) -> float:
    """Mass of an element (most abundant isotope, or abundance-weighted) or of one isotope, ``C[13]``."""
    table = table or NIST_MASS
    if symbol.endswith("]"):
        el, iso = symbol[:-1].split("[")
        return table[el][int(iso)][0]
    isotopes = table[symbol]
    if average:
        return sum(m * a for k, (m, a) in isotopes.items() if k) or isotopes[0][0]
    return isotopes[0][0]


def composition_mass(comp: dict[str, int], average: bool = False) -> float:
    return sum(element_mass(k, average) * n for k, n in comp.items())


WATER = composition_mass({"H": 2, "O": 1})
ION_DELTA: dict[str, float] = {k: composition_mass(formula_composition(f)) for k, f in ION_FORMULA.items()}
