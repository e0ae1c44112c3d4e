"""Table operators over long panels."""
