"""Column helpers: null discipline, trailing windows, moments."""
