"""DataFrame operators: coefficients, fluence, objective, masks, dose-volume, volumes, texture, cohorts."""
