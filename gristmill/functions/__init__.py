"""Part of gristmill; see the README."""
