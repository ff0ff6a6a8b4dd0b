"""Rules, checkpoints and criteria as data. Standards: ISO 14289-1, the Matterhorn Protocol 1.1 and WCAG 2.2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    id: str
    group: str
    layer: str
    severity: str
    requires: str | None
    clause: str | None
    checkpoint: str | None
    wcag: str  # criteria, separated by spaces
    elsewhere: bool  # the usual validator has a test for it
    status: str
    title: str
    fix: str

    @property
    def criteria(self) -> tuple[str, ...]:
        return tuple(self.wcag.split())


@dataclass(frozen=True)
class Criterion:
    framework: str
    id: str
    name: str
    level: str | None
    requires: str | None
    by_hand: bool  # part of it is for people to judge


# fmt: off
RULES = [
    Rule('DOC-001', 'document', 'conformance', 'error', None, '7.1', '01', "1.3.1", False, 'active', 'Marked flag set', "Set Marked to true in the catalog's MarkInfo"),
    Rule("DOC-002", "document", "conformance", "error", None, "7.1", "01", "1.3.1 1.3.2", True, "active", "Structure tree exists", "Tag the document so that it has a structure tree"),
    Rule("DOC-003", "document", "conformance", "error", None, "7.1", "01", "1.3.1", True, "active", "No suspect tags", "Review the tags and clear the Suspects flag"),
    Rule("DOC-004", "document", "semantic", "error", "scanned", None, None, "1.1.1 1.4.5", True, "active", "Scans carry recognised text", "Run text recognition over scanned pages"),
    Rule("DOC-010", "document", "conformance", "error", None, "7.1", "06", "2.4.2", True, "active", "Metadata title exists", "Write a title into the XMP metadata"),
    Rule("DOC-011", "document", "conformance", "error", None, "7.1", "07", "2.4.2", True, "active", "Title shown in the window", "Set DisplayDocTitle in the viewer preferences"),
    Rule("DOC-012", "document", "conformance", "error", None, "7.1", "06", "", True, "active", "PDF/UA part declared", "Declare part 1 in the XMP metadata"),
    Rule("DOC-013", "document", "conformance", "error", None, "7.2", "11", "3.1.1", True, "active", "Document language declared", "Set a language on the catalog"),
    Rule("DOC-014", "document", "conformance", "warning", "lang", "7.2", "11", "3.1.1", True, "active", "Language tag is valid", "Use a BCP 47 tag such as en or de-AT"),
    Rule("DOC-015", "document", "conformance", "warning", "title", "7.1", "06", "2.4.2", False, "active", "Both titles say the same", "Make the Info title equal to the XMP title"),
    Rule("DOC-020", "document", "conformance", "error", "encrypted", "7.1", "26", "1.3.1", True, "active", "Assistive technology may read", "Allow extraction for accessibility"),
    Rule("DOC-030", "document", "conformance", "error", "oc", "7.10", "20", "1.3.1", True, "active", "Layer configurations are named", "Name each configuration and remove automatic states"),
    Rule("DOC-021", "document", "conformance", "error", "acroform", "7.15", "25", "4.1.2", True, "active", "No dynamic XFA form", "Replace the XFA form by a plain one"),
    Rule("DOC-031", "document", "conformance", "warning", "embedded", "7.11", "21", "", True, "active", "Attachments are described", "Give every attachment both file names and a description"),
    Rule("DOC-040", "document", "semantic", "warning", "title", None, "06", "2.4.2", True, "active", "Title reads as a title", "Write a title that a person would recognise"),
    Rule("TAG-001", "tagging", "conformance", "error", "struct", "7.1", "01", "1.3.1 1.3.2", True, "active", "All painted content is tagged or artifact", "Tag it or mark it as an artifact"),
    Rule('TAG-002', 'tagging', 'semantic', 'error', None, '7.1', '01', "1.3.1", True, 'active', "Prose isn't hidden as artifact", 'Tag the lines that hold prose'),
    Rule("TAG-003", "tagging", "semantic", "warning", "struct", None, "01", "1.3.1", True, "active", "Printed words are announced", "Tag the content that prints these words"),
    Rule('TAG-004', 'tagging', 'conformance', 'error', 'struct', '7.1', '01', "1.3.1", False, 'active', "Tags and artifacts don't nest", 'Close artifacts before tagged content starts'),
    Rule("TAG-010", "tagging", "conformance", "error", "struct", "7.1", "02", "1.3.1 4.1.2", True, "active", "Types map to standard types", "Map the type in the role map"),
    Rule("TAG-011", "tagging", "conformance", "error", "struct", "7.1", "02", "1.3.1 4.1.2", True, "active", "Role map has no loop", "Break the loop in the role map"),
    Rule("TAG-012", "tagging", "conformance", "error", "struct", "7.1", "02", "1.3.1 4.1.2", True, "active", "Standard types keep their meaning", "Remove the mapping of the standard type"),
    Rule('TAG-020', 'tagging', 'semantic', 'warning', 'struct', None, '09', "1.3.1", True, 'active', "Elements aren't empty", 'Remove the element or give it content'),
    Rule("TAG-021", "tagging", "conformance", "error", "struct", "7.1", "01", "1.3.1", False, "active", "Elements point at real pages", "Correct the page references"),
    Rule("TAG-022", "tagging", "conformance", "error", "struct", "7.1", "01", "1.3.1 1.3.2", False, "active", "Content has one owner", "Let one element claim each content id"),
    Rule("TAG-023", "tagging", "conformance", "error", "struct", "7.1", "01", "1.3.1", True, "active", "Elements name their parent", "Write the parent entry"),
    Rule("TAG-040", "tagging", "conformance", "error", "xobjects", "7.20", "30", "1.3.1", True, "active", "No content from other files", "Embed the referenced content"),
    Rule('TAG-030', 'tagging', 'semantic', 'warning', 'figures', None, '13', "1.1.1 1.3.1", True, 'active', "A page scan isn't a figure", 'Mark the background scan as an artifact'),
    Rule('TAG-031', 'tagging', 'semantic', 'error', 'struct', None, None, "1.1.1", True, 'active', "Alternatives don't hide text", 'Move the alternative to a figure or extend it'),
    Rule("TAG-032", "tagging", "semantic", "error", "struct", None, None, "1.1.1", True, "active", "Replacement text matches", "Correct the replacement text"),
    Rule("TXT-001", "text", "conformance", "error", "fonts", "7.21.3.1", "31", "", True, "active", "Fonts are embedded", "Embed the fonts"),
    Rule("TXT-002", "text", "conformance", "error", "fonts", "7.21.7", "10", "1.3.1", True, "active", "Fonts can be read", "Add a mapping to Unicode"),
    Rule("TXT-003", "text", "conformance", "error", "fonts", "7.21.7", "10", "1.3.1", True, "active", "All codes map to Unicode", "Complete the mapping"),
    Rule("TXT-004", "text", "semantic", "warning", "fonts", None, "10", "1.3.1", True, "active", "Mapping is plausible", "Rebuild the mapping"),
    Rule("TXT-005", "text", "conformance", "error", "fonts", "7.21.8", "31", "1.3.1", True, "active", "No missing glyphs shown", "Embed the missing glyphs"),
    Rule("TXT-006", "text", "conformance", "error", "fonts", "7.21.7", "10", "1.3.1", True, "active", "No noncharacters in mapping", "Map the codes to real characters"),
    Rule("TXT-007", "text", "conformance", "error", "fonts", "7.21.3.2", "31", "", True, "active", "CID fonts map to glyphs", "Add a CIDToGIDMap"),
    Rule("TXT-010", "text", "semantic", "error", "text", None, None, "", True, "active", "Invisible text has a visible source", "Restore the page image"),
    Rule("TXT-011", "text", "conformance", "error", "xobjects", "7.1", "01", "1.3.1 1.3.2", True, "active", "Text in forms is tagged", "Tag the text of the form XObject"),
    Rule('HDG-001', 'headings', 'conformance', 'error', 'headings', '7.4', '14', "1.3.1 2.4.6", True, 'active', "Heading levels don't skip", 'Use the next level down'),
    Rule("HDG-002", "headings", "conformance", "error", "headings", "7.4", "14", "1.3.1 2.4.6", True, "active", "First heading is level one", "Start with a first-level heading"),
    Rule("HDG-003", "headings", "conformance", "error", "headings", "7.4", "14", "1.3.1 2.4.6", True, "active", "One heading scheme", "Use numbered headings throughout"),
    Rule("HDG-004", "headings", "conformance", "error", "headings", "7.4", "14", "1.3.1 2.4.6", True, "planned", "No heading below level six", "Restructure deep levels"),
    Rule("HDG-005", "headings", "conformance", "error", "headings", "7.4.4", "14", "1.3.1 2.4.6", True, "active", "One unnumbered heading a section", "Keep one heading per section"),
    Rule("HDG-010", "headings", "semantic", "warning", "headings", None, "14", "2.4.6", True, "active", "Headings read as headings", "Tag the text as a paragraph"),
    Rule('HDG-011', 'headings', 'semantic', 'warning', 'headings', None, '14', "2.4.6", True, 'active', "Headings aren't paragraphs", 'Tag the text as a paragraph'),
    Rule("HDG-012", "headings", "semantic", "warning", "struct", None, "14", "1.3.1", True, "active", "Long documents have headings", "Tag the headings"),
    Rule("TBL-001", "tables", "conformance", "error", "tables", "7.5", "15", "1.3.1", False, "active", "Tables have header cells", "Tag header cells"),
    Rule("TBL-002", "tables", "conformance", "error", "tables", "7.5", "15", "1.3.1", True, "active", "Header cells have a scope", "Set the scope or refer to the cell"),
    Rule("TBL-003", "tables", "conformance", "error", "tables", "7.5", "15", "1.3.1", True, "active", "Cells sit in rows of tables", "Move cells into rows and rows into tables"),
    Rule("TBL-004", "tables", "conformance", "error", "tables", "7.5", "15", "1.3.1", True, "active", "Rows are equally wide", "Correct the spans"),
    Rule('TBL-005', 'tables', 'conformance', 'error', 'tables', '7.5', '15', "1.3.1", True, 'active', 'Table parts nest properly', "Restructure the table's children"),
    Rule('TBL-010', 'tables', 'semantic', 'error', 'tables', None, '15', "1.3.1", True, 'active', "Header cells aren't split up", 'Merge the header cells'),
    Rule("TBL-011", "tables", "semantic", "warning", "tables", None, "15", "1.3.1", True, "active", "Headers have text", "Fill the header cells"),
    Rule("TBL-012", "tables", "semantic", "warning", "tables", None, "15", "1.3.1", True, "active", "Tables hold data", "Untag layout tables"),
    Rule('TBL-013', 'tables', 'semantic', 'warning', 'tables', None, '15', "1.3.1", True, 'active', "Tables aren't split", 'Merge the neighbouring tables'),
    Rule("TBL-014", "tables", "semantic", "warning", None, None, "15", "1.3.1", True, "active", "Ruled grids are tables", "Tag the grid as a table"),
    Rule('TBL-015', 'tables', 'semantic', 'warning', 'tables', None, '15', "1.3.1", True, 'active', "Cells aren't collapsed", 'Split the cell into its columns'),
    Rule("LST-001", "lists", "conformance", "error", "lists", "7.6", "16", "1.3.1", True, "active", "List items sit in lists", "Put the item into a list"),
    Rule("LST-002", "lists", "conformance", "warning", "lists", "7.6", "16", "1.3.1", True, "active", "List items have a body", "Add a list body"),
    Rule("LST-003", "lists", "conformance", "error", "lists", "7.6", "16", "1.3.1", True, "active", "Lists hold list items", "Wrap the child into a list item"),
    Rule('LST-004', 'lists', 'conformance', 'warning', 'lists', '7.6', '16', "1.3.1", True, 'active', 'Nested lists sit in bodies', "Move the list into the item's body"),
    Rule("FIG-001", "figures", "conformance", "error", "figures", "7.3", "13", "1.1.1", True, "active", "Figures have alternatives", "Describe the figure"),
    Rule('FIG-002', 'figures', 'semantic', 'error', 'figures', '7.3', '13', "1.1.1", True, 'active', "Alternatives aren't blank", 'Describe the figure'),
    Rule('FIG-010', 'figures', 'semantic', 'warning', 'figures', None, '13', "1.1.1", True, 'active', "Alternatives aren't placeholders", 'Describe what the figure shows'),
    Rule('FIG-011', 'figures', 'semantic', 'info', 'figures', None, '13', "1.1.1", True, 'active', 'Alternative differs from caption', "Say what the caption doesn't"),
    Rule("FIG-012", "figures", "semantic", "warning", "figures", None, "13", "1.1.1", True, "active", "Alternatives read as language", "Rewrite the description"),
    Rule("LNK-001", "links", "conformance", "error", "links", "7.18.5", "28", "1.3.1 2.4.4", True, "active", "Link annotations are tagged", "Put the annotation into a Link element"),
    Rule("LNK-002", "links", "conformance", "error", "annots", "7.18.1", "28", "1.1.1 2.4.4", True, "active", "Annotations are described", "Write contents for the annotation"),
    Rule("LNK-003", "links", "semantic", "error", "links", None, "28", "2.4.4 4.1.2", True, "active", "Links have a name", "Give the link text or an alternative"),
    Rule("LNK-004", "links", "conformance", "warning", "annots", "7.18.1", "28", "", False, "active", "Annotation flags agree", "Set Print and clear NoView"),
    Rule("LNK-006", "links", "conformance", "error", "annots", "7.18.1", "28", "1.3.1 1.3.2", True, "active", "Annotations are tagged", "Put the annotation into an Annot element"),
    Rule("LNK-005", "links", "conformance", "error", "annots", "7.18.3", "28", "2.4.3", True, "active", "Tab order follows structure", "Set Tabs to S on the page"),
    Rule("LNK-010", "links", "semantic", "warning", "text", None, None, "", True, "active", "Addresses are links", "Add link annotations"),
    Rule("FRM-001", "forms", "conformance", "error", "forms", "7.18.1", "28", "1.3.1 3.3.2 4.1.2", True, "active", "Fields have names", "Write a TU entry"),
    Rule("FRM-003", "forms", "conformance", "error", "forms", "7.18.4", "28", "1.3.1 1.3.2 4.1.2", True, "active", "Fields are tagged", "Put the widget into a Form element"),
    Rule("FRM-002", "forms", "semantic", "warning", "forms", None, "28", "3.3.2 4.1.2", True, "active", "Field names are meant for people", "Replace the generated name"),
    Rule("NOTE-001", "notes", "conformance", "error", "notes", "7.9", "19", "1.3.1", True, "active", "Notes have ids", "Give the note an id"),
    Rule("NOTE-004", "notes", "conformance", "error", "notes", "7.9", "19", "1.3.1", True, "active", "Note ids are unique", "Make the ids unique"),
    Rule("NOTE-002", "notes", "semantic", "warning", "notes", None, "19", "1.3.1", True, "active", "References lead to notes", "Link the reference to its note"),
    Rule("NOTE-003", "notes", "semantic", "warning", "notes", None, "19", "1.3.1", True, "active", "Notes are labelled once", "Label the note and remove the copy"),
    Rule("MATH-001", "math", "conformance", "error", "formulas", "7.7", "17", "1.1.1", True, "active", "Formulae have alternatives", "Describe the formula"),
    Rule("MATH-010", "math", "semantic", "warning", "formulas", None, "17", "1.1.1", True, "active", "Formula alternatives are speech", "Write the formula as it is read out"),
    Rule('MATH-011', 'math', 'semantic', 'error', 'formulas', None, '17', "1.1.1 1.3.1", True, 'active', "Formulae don't hide prose", 'Tag the prose outside the formula'),
    Rule("ORD-001", "order", "semantic", "warning", "struct", None, "09", "1.3.2", True, "active", "Tag order follows the page", "Reorder the tags"),
    Rule('ORD-002', 'order', 'semantic', 'warning', 'struct', None, '09', "1.3.2", True, 'planned', "Elements don't jump pages", 'Split the element'),
    Rule("NAV-001", "navigation", "semantic", "warning", None, None, "27", "2.4.5", True, "active", "Long documents have bookmarks", "Add bookmarks"),
    Rule("PAG-001", "pagination", "conformance", "warning", "pages3", "7.8", "18", "1.3.1 2.4.1", True, "active", "Running lines are artifacts", "Mark headers and footers as artifacts"),
    Rule("SEM-001", "quality", "semantic", "error", "source", None, None, "1.3.1", True, "active", "Structure is kept", "Restore the lost structure"),
    Rule("SEM-002", "quality", "semantic", "error", "source", None, None, "1.3.1", True, "active", "Text is kept", "Restore the lost text"),
    Rule('SEM-003', 'quality', 'semantic', 'error', 'source', None, None, "", True, 'active', 'Appearance is kept', "Restore the page's appearance"),
]

CRITERIA = [
    Criterion('pdfua1', '01', 'Real content tagged', None, None, False),
    Criterion('pdfua1', '02', 'Role mapping', None, None, False),
    Criterion('pdfua1', '03', 'Flickering', None, 'media', True),
    Criterion('pdfua1', '04', 'Color and contrast', None, None, True),
    Criterion('pdfua1', '05', 'Sound', None, 'media', True),
    Criterion('pdfua1', '06', 'Metadata', None, None, False),
    Criterion('pdfua1', '07', 'Dictionary', None, None, False),
    Criterion('pdfua1', '08', 'OCR validation', None, 'scanned', True),
    Criterion('pdfua1', '09', 'Appropriate tags', None, None, True),
    Criterion('pdfua1', '10', 'Character mappings', None, None, False),
    Criterion('pdfua1', '11', 'Declared natural language', None, None, False),
    Criterion('pdfua1', '12', 'Stretchable characters', None, 'text', True),
    Criterion('pdfua1', '13', 'Graphics', None, 'figures', False),
    Criterion('pdfua1', '14', 'Headings', None, 'headings', False),
    Criterion('pdfua1', '15', 'Tables', None, 'tables', False),
    Criterion('pdfua1', '16', 'Lists', None, 'lists', False),
    Criterion('pdfua1', '17', 'Mathematical expressions', None, 'formulas', False),
    Criterion('pdfua1', '18', 'Page headers and footers', None, 'pages3', False),
    Criterion('pdfua1', '19', 'Notes and references', None, 'notes', False),
    Criterion('pdfua1', '20', 'Optional content', None, 'oc', False),
    Criterion('pdfua1', '21', 'Embedded files', None, 'embedded', False),
    Criterion('pdfua1', '22', 'Article threads', None, 'threads', True),
    Criterion('pdfua1', '23', 'Digital signatures', None, 'signatures', True),
    Criterion('pdfua1', '24', 'Non-interactive forms', None, 'text', True),
    Criterion('pdfua1', '25', 'XFA', None, 'acroform', False),
    Criterion('pdfua1', '26', 'Security', None, 'encrypted', False),
    Criterion('pdfua1', '27', 'Navigation', None, None, False),
    Criterion('pdfua1', '28', 'Annotations', None, 'annots', False),
    Criterion('pdfua1', '29', 'Actions', None, 'actions', True),
    Criterion('pdfua1', '30', 'XObjects', None, 'xobjects', False),
    Criterion('pdfua1', '31', 'Fonts', None, None, False),
    Criterion('wcag22', '1.1.1', 'Non-text Content', 'A', None, False),
    Criterion('wcag22', '1.2.1', 'Audio-only and Video-only (Prerecorded)', 'A', 'media', True),
    Criterion('wcag22', '1.2.2', 'Captions (Prerecorded)', 'A', 'media', True),
    Criterion('wcag22', '1.2.3', 'Audio Description or Media Alternative (Prerecorded)', 'A', 'media', True),
    Criterion('wcag22', '1.2.4', 'Captions (Live)', 'AA', 'never', True),
    Criterion('wcag22', '1.2.5', 'Audio Description (Prerecorded)', 'AA', 'media', True),
    Criterion('wcag22', '1.3.1', 'Info and Relationships', 'A', None, False),
    Criterion('wcag22', '1.3.2', 'Meaningful Sequence', 'A', None, False),
    Criterion('wcag22', '1.3.3', 'Sensory Characteristics', 'A', None, True),
    Criterion('wcag22', '1.3.4', 'Orientation', 'AA', 'never', True),
    Criterion('wcag22', '1.3.5', 'Identify Input Purpose', 'AA', 'forms', True),
    Criterion('wcag22', '1.4.1', 'Use of Color', 'A', None, True),
    Criterion('wcag22', '1.4.2', 'Audio Control', 'A', 'media', True),
    Criterion('wcag22', '1.4.3', 'Contrast (Minimum)', 'AA', None, True),
    Criterion('wcag22', '1.4.4', 'Resize Text', 'AA', None, True),
    Criterion('wcag22', '1.4.5', 'Images of Text', 'AA', None, True),
    Criterion('wcag22', '1.4.10', 'Reflow', 'AA', None, True),
    Criterion('wcag22', '1.4.11', 'Non-text Contrast', 'AA', None, True),
    Criterion('wcag22', '1.4.12', 'Text Spacing', 'AA', None, True),
    Criterion('wcag22', '1.4.13', 'Content on Hover or Focus', 'AA', 'annots', True),
    Criterion('wcag22', '2.1.1', 'Keyboard', 'A', 'interactive', True),
    Criterion('wcag22', '2.1.2', 'No Keyboard Trap', 'A', 'interactive', True),
    Criterion('wcag22', '2.1.4', 'Character Key Shortcuts', 'A', 'actions', True),
    Criterion('wcag22', '2.2.1', 'Timing Adjustable', 'A', 'actions', True),
    Criterion('wcag22', '2.2.2', 'Pause, Stop, Hide', 'A', 'media', True),
    Criterion('wcag22', '2.3.1', 'Three Flashes or Below Threshold', 'A', 'media', True),
    Criterion('wcag22', '2.4.1', 'Bypass Blocks', 'A', None, False),
    Criterion('wcag22', '2.4.2', 'Page Titled', 'A', None, False),
    Criterion('wcag22', '2.4.3', 'Focus Order', 'A', 'annots', False),
    Criterion('wcag22', '2.4.4', 'Link Purpose (In Context)', 'A', 'links', False),
    Criterion('wcag22', '2.4.5', 'Multiple Ways', 'AA', None, False),
    Criterion('wcag22', '2.4.6', 'Headings and Labels', 'AA', None, False),
    Criterion('wcag22', '2.4.7', 'Focus Visible', 'AA', 'interactive', True),
    Criterion('wcag22', '2.4.11', 'Focus Not Obscured (Minimum)', 'AA', 'interactive', True),
    Criterion('wcag22', '2.5.1', 'Pointer Gestures', 'A', 'actions', True),
    Criterion('wcag22', '2.5.2', 'Pointer Cancellation', 'A', 'actions', True),
    Criterion('wcag22', '2.5.3', 'Label in Name', 'A', 'forms', True),
    Criterion('wcag22', '2.5.4', 'Motion Actuation', 'A', 'never', True),
    Criterion('wcag22', '2.5.7', 'Dragging Movements', 'AA', 'actions', True),
    Criterion('wcag22', '2.5.8', 'Target Size (Minimum)', 'AA', 'interactive', True),
    Criterion('wcag22', '3.1.1', 'Language of Page', 'A', None, False),
    Criterion('wcag22', '3.1.2', 'Language of Parts', 'AA', 'struct', True),
    Criterion('wcag22', '3.2.1', 'On Focus', 'A', 'forms', True),
    Criterion('wcag22', '3.2.2', 'On Input', 'A', 'forms', True),
    Criterion('wcag22', '3.2.3', 'Consistent Navigation', 'AA', 'pages3', True),
    Criterion('wcag22', '3.2.4', 'Consistent Identification', 'AA', None, True),
    Criterion('wcag22', '3.2.6', 'Consistent Help', 'A', 'forms', True),
    Criterion('wcag22', '3.3.1', 'Error Identification', 'A', 'forms', True),
    Criterion('wcag22', '3.3.2', 'Labels or Instructions', 'A', 'forms', False),
    Criterion('wcag22', '3.3.3', 'Error Suggestion', 'AA', 'forms', True),
    Criterion('wcag22', '3.3.4', 'Error Prevention (Legal, Financial, Data)', 'AA', 'forms', True),
    Criterion('wcag22', '3.3.7', 'Redundant Entry', 'A', 'forms', True),
    Criterion('wcag22', '3.3.8', 'Accessible Authentication (Minimum)', 'AA', 'forms', True),
    Criterion('wcag22', '4.1.2', 'Name, Role, Value', 'A', None, False),
    Criterion('wcag22', '4.1.3', 'Status Messages', 'AA', 'actions', True),
# fmt: on
]

BY_ID = {r.id: r for r in RULES}
if len(BY_ID) != len(RULES):
    raise ValueError("a rule id is used twice")

#: Features of a document that rules and criteria may require, and what to say where one is absent.
FEATURES = {
    "source": "no source to compare with", "struct": "no structure tree", "text": "no text", "fonts": "no fonts", "headings": "no headings",
    "tables": "no tables", "lists": "no lists", "figures": "no figures", "formulas": "no formulae", "notes": "no notes or references",
    "links": "no links", "annots": "no annotations", "forms": "no form fields", "acroform": "no interactive form", "interactive": "nothing interactive",
    "media": "no media", "actions": "no scripts or actions", "encrypted": "not encrypted", "oc": "no optional content", "embedded": "no attachments",
    "threads": "no article threads", "signatures": "no signature fields", "xobjects": "no form XObjects", "scanned": "no page images",
    "lang": "no language to test", "title": "no title to test", "pages3": "fewer than three pages",
}

STANDARD_TYPES = (
    "Annot Art BibEntry BlockQuote Caption Code Div Document Figure Form Formula H H1 H2 H3 H4 H5 H6 Index L LBody LI Lbl Link NonStruct Note P Part "
    "Private Quote RB RP RT Reference Ruby Sect Span TBody TD TFoot TH THead TOC TOCI TR Table WP WT Warichu"
).split()

RULE_COLUMNS = "rule string, pos int, grp string, layer string, severity string, requires string, clause string, checkpoint string, criteria array<string>, status string, title string, fix string"


def rules_df(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The catalogue as a table of 91 rows at most."""
    rows = [(r.id, i, r.group, r.layer, r.severity, r.requires, r.clause, r.checkpoint, list(r.criteria), r.status, r.title, r.fix) for i, r in enumerate(RULES if rules is None else rules)]
    return spark.createDataFrame(rows, RULE_COLUMNS)


def criteria_df(spark: SparkSession) -> DataFrame:
    rows = [(c.framework, i, c.id, c.name, c.level, c.requires, c.by_hand) for i, c in enumerate(CRITERIA)]
    return spark.createDataFrame(rows, "framework string, cpos int, criterion string, name string, level string, needs string, by_hand boolean")


def select(only=None, skip=None, layers=None) -> list[Rule]:
    """Rules left after the selection; an unknown id is an error."""
    for r in (*(only or ()), *(skip or ())):
        if r not in BY_ID:
            raise KeyError(f"no rule {r}")
    return [r for r in RULES if (not only or r.id in only) and (not skip or r.id not in skip) and (not layers or r.layer in layers)]
