"""Part of trajmill; see the README."""
