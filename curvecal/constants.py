"""Fixed values of the calibration protocol.

Fixed values: these must stay as they are for results to agree with published ones.
"""

BASELINE_V = -0.4507

ROI_LOW_V = -0.3078
ROI_HIGH_V = -0.0629
ROI_WINDOWS = {
    "A": (-0.3078, -0.0629),
    "B": (-0.4507, -0.0629),
    "C": (-0.3385, -0.0526),
}

MIN_ROI_POINTS = 5
EPS = 1e-12
SMOOTH_WINDOW = 5
GRID_ATOL = 1e-6
NAME_DECIMALS = 4

FEATURES = [
    "Ip_corr", "Ep", "Area_peak", "FWHM", "Peak_to_bg",
    "Slope_rise", "Slope_fall", "Symmetry",
    "dIdE_max", "d2IdE2_max",
    "Mean", "Var", "Skew", "Kurtosis", "Energy",
]
FLAGGED = ["FWHM", "Slope_fall", "Symmetry", "Peak_to_bg"]
META = ["sample_id", "concentration_ppb", "source_file"]
TARGET = "concentration_ppb"
NOT_FEATURES = ["sample_id", "source_file", "concentration_ppb", "dataset"]

HOLDOUT_FRACTION = 0.50
N_BINS = 7
N_FOLDS = 5
MIN_PER_BIN = 2
SEED = 42

OUTLIER_PPB = 16.9
OUTLIER_TOL = 0.01
THRESHOLD_PPB = 15.0
COVERAGE_PCT = 0.15
INTERVAL_Z = 1.96
INTERVAL_SPREAD = 0.2
HIST_BINS = 15
PICK_TARGETS = [0.0, 10.0, 25.0, 35.0, 50.0]
PICK_TOL = 3.0
PICK_LIMIT = 6

# (label, low, high): low < y <= high; None leaves the top open.
BUCKETS = [
    ("0-5", 0.0, 5.0),
    ("5-10", 5.0, 10.0),
    ("10-15", 10.0, 15.0),
    ("15-25", 15.0, 25.0),
    (">25", 25.0, None),
]

RIDGE_ALPHA = 1.0
LASSO_ALPHA = 0.01
RIDGE_GRID = [0.1, 1.0, 5.0, 10.0]
LASSO_GRID = [0.001, 0.01, 0.1, 1.0]
LATENT_DEFAULT = 5
LATENT_GRID = [2, 3, 5, 8, 12, 15]
PCR_RIDGE_GRID = [0.0, 0.1, 1.0, 5.0]
RBF_C = 10.0
RBF_C_GRID = [1.0, 3.0, 10.0, 30.0]
RBF_GAMMA_GRID = ["scale", 0.1, 0.01]
FOREST = {"trees": 300, "depth": 7, "min_leaf": 2}
FOREST_GRID = {"trees": [200, 400, 800], "depth": [5, 7, 9, None], "min_leaf": [1, 2, 4]}
BOOST = {"rounds": 400, "depth": 4, "rate": 0.05, "subsample": 0.9, "colsample": 0.9}
BOOST_GRID = {
    "rounds": [300, 600, 900], "depth": [3, 4, 5], "rate": [0.03, 0.05, 0.1],
    "subsample": [0.8, 1.0], "colsample": [0.8, 1.0],
}
